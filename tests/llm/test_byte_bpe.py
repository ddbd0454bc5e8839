import random

import public_tokenizers as public
import tiktoken

from quarry.llm import byte_bpe as bpe

from . import frames

RANKS = public.path("byte_bpe_50k.tiktoken")


def tokenizer():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(5)
    out = ["a" * 3000, "".join(rng.choice("abcdefghij") for _ in range(4000)), "don't I'LL we'll THEY'RE 'sd",
           "  two\n\n\n lines \t\x0b end  ", "　\x85\xa0 x", "<|endoftext|>", "12345 6½ ٣٤ Ⅷ", "".join(map(chr, range(0x300)))]
    for _ in range(40):
        out.append("".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0xA0, 0x3000), rng.randrange(0x10000, 0x32000)]))
                           for _ in range(120)))
    # characters that the pattern libraries class apart
    less = sorted(set().union(*(a | b for a, b in bpe.class_differences().values())))
    return out + ["x" + c + " 1" + c + "," + c for c in less[::400]]


def test_against_the_tokenizer(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 3000)
    docs = frames.awkward(spark).select("doc_id", "text").unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts())], "doc_id long, text string"))
    encoding = tokenizer()
    want = []
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), b"".join(i.to_bytes(4, "little") for i in ids), (r.text or "").encode()))
    done = bpe.decode(bpe.encode(docs, RANKS, public.PATTERN), RANKS).select("doc_id", "n_tokens", "packed", "decoded", "ids").collect()
    frames.same([(r.doc_id, r.n_tokens, bytes(r.packed), bytes(r.decoded)) for r in done], want)
    assert all(b"".join(i.to_bytes(4, "little") for i in r.ids) == bytes(r.packed) for r in done)


def test_extra_columns_and_empty_table(spark):
    assert bpe.decode(bpe.encode(frames.empty(spark), RANKS, public.PATTERN), RANKS).count() == 0
    assert bpe.encode(frames.awkward(spark), RANKS, public.PATTERN).count() == frames.awkward(spark).count()


def test_heap_takes_the_same_merges():
    ranks, encoding, rng = bpe.read_ranks(RANKS), tokenizer(), random.Random(9)
    for n in (1, 2, 3, 17, 400, 2000):
        for letters in ("ab", "aeinorst", "abcdefghijklmnopqrstuvwxyz", "éàü"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert bpe.merge_by_heap(word.encode(), ranks) == encoding.encode_ordinary(word)


def test_ascii_texts_are_split_alike():
    import regex

    every = [chr(i) for i in range(128)]
    texts = [a + b for a in every for b in every]
    texts += ["".join(random.Random(i).choice("aZ09 _'sdt\n\t.-\x1c\x1f") for _ in range(300)) for i in range(300)]
    usual, plain = regex.compile(public.PATTERN), bpe.ascii_splitter(public.PATTERN)
    assert plain and all(plain.findall(t) == usual.findall(t) for t in [*texts, "".join(every), "".join(texts)])
    for other in (r"(?i:'s)|\p{L}+", r"\p{Lu}+", r"\w+", r"[^\r\n]+", r"\p{L}++", r"[\p{L}--[a]]"):
        assert bpe.ascii_splitter(other) is None
