"""Plan parameters and the fixed values every engine must agree on."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass
from typing import Optional

# ---------------------------------------------------------------------------
# Fixed values. Spark, the pandas helpers and the DuckDB oracle all use these
# exact strings and numbers; changing one changes results.
# ---------------------------------------------------------------------------
# A sentence: a run of characters other than . ! ? and newline, plus any
# terminal punctuation that follows it. No look-around (DuckDB's RE2 has none).
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"
# A word token for retrieval: letters and digits of any script.
WORD_PATTERN = r"[\p{L}\p{N}]+"
# A whitespace token: used for chunk sizes and token budgets.
SPACE_TOKEN_PATTERN = r"\S+"
# Hashed bag-of-words embedder: number of buckets.
HASH_DIM = 64
# BM25 parameters (Robertson & Zaragoza 2009).
BM25_K1 = 1.5
BM25_B = 0.75
# Score rounding before any ranking, so engines break ties alike.
SCORE_DECIMALS = 6
# Model limits used by the context budget (public library defaults).
DEFAULT_CONTEXT_WINDOW = 3900
DEFAULT_NUM_OUTPUT = 256


@dataclass(frozen=True)
class Chunking:
    """How documents become nodes, and how far a sentence's window reaches."""

    kind: str = "sentence_window"  # or "token" (B3), "sentence_pack" (B4), "document" (one node each)
    window: int = 3
    size: int = 512
    overlap: int = 128

    def __post_init__(self) -> None:
        if self.kind not in ("sentence_window", "token", "sentence_pack", "document"):
            raise ValueError(f"unknown chunker {self.kind!r}")
        if not 0 <= self.overlap < self.size:
            raise ValueError("need 0 <= overlap < size")


@dataclass(frozen=True)
class Layout:
    """The index on disk: document partitions (0: from the input's size at the first build), dimensions
    of the default embedder, stemmed terms."""

    partitions: int = 0
    dim: int = HASH_DIM
    stemming: bool = False


@dataclass(frozen=True)
class Search:
    """Hits of the dense list and of the keyword list (None: dense alone), their fusion; C4."""

    dense: int = 5
    keyword: Optional[int] = 12
    keyword_weight: float = 0.3
    fusion: str = "OR"
    pseudo_documents: bool = False

    def __post_init__(self) -> None:
        if self.fusion not in ("AND", "OR"):
            raise ValueError(f"fusion {self.fusion!r} is neither AND nor OR")


@dataclass(frozen=True)
class Context:
    """What of the hits goes into a prompt. ``keep`` None: all hits, not reranked."""

    keep: Optional[int] = 2
    metadata: str = "window"
    order: str = "forward"
    limit: int = DEFAULT_CONTEXT_WINDOW
    reserved: int = DEFAULT_NUM_OUTPUT

    def __post_init__(self) -> None:
        if self.order not in ("forward", "reverse", "sides"):
            raise ValueError(f"unknown order {self.order!r}")
        if self.limit <= 0:
            raise ValueError("the context limit must be > 0")


@dataclass(frozen=True)
class Synthesis:
    """How answers are made, and from which keyword score on a query is retrieved for."""

    mode: str = "simple_summarize"  # or tree_summarize, generation
    fan_in: int = 2
    route_at: float = 30.0

    def __post_init__(self) -> None:
        if self.mode not in ("simple_summarize", "tree_summarize", "generation"):
            raise ValueError(f"unknown response mode {self.mode!r}")


@dataclass(frozen=True)
class RagConfig:
    """What a plan reads, by stage. One frozen value picks the whole plan before it is built; the index
    depends on its first two parts alone."""

    chunking: Chunking = Chunking()
    layout: Layout = Layout()
    search: Search = Search()
    context: Context = Context()
    synthesis: Synthesis = Synthesis()

    def but(self, **parts: dict) -> "RagConfig":
        """A copy with some fields of some parts changed: ``cfg.but(search={"keyword": None})``."""
        return dataclasses.replace(self, **{name: dataclasses.replace(getattr(self, name), **fields)
                                            for name, fields in parts.items()})

    def index_fingerprint(self) -> str:
        """Digest of everything that shapes the index tables (A6: stale-proof paths)."""
        blob = json.dumps([dataclasses.asdict(self.chunking), dataclasses.asdict(self.layout)], sort_keys=True)
        return hashlib.md5(blob.encode()).hexdigest()[:12]
