"""Cross-tokenizer alignment against a plain walk over both tokenizers' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fieldleaf.llm import alignment
from fieldleaf.llm.queries import QUERIES, token_files

ODD = ["", None, " ", "  two  spaces ", "a\n\n b \n c\td", " \n\n  x", "x  \ny", "▁ low ▁line", "ﬁ ① é　x​\x00y", "<s> </s><unk> <|endoftext|>", "日本語 のテキスト 😀😀", "a" * 3000, "long words " * 3000, "won't we'll I'M 12 345,6", " nb  em \x1c sep", "é" * 50 + " é"]


def plain(text):
    """(a ids, b ids, groups, links) by the contract's words, with the library that reads the JSON file."""
    a_file, b_file = token_files()
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(a_file.replace(".tiktoken", ".json"))
    coder.encode_special_tokens = True
    coded = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
    free = iter(range(256, 512))
    coded |= {chr(next(free)): b for b in range(256) if b not in coded.values()}
    _, b_bytes = alignment.piece_tokenizer(b_file)
    for t in text:
        if not t:
            yield [], [], [], []
            continue
        a = coder.encode(" " + t, add_special_tokens=False).ids
        b = alignment.piece_tokenizer(b_file)[0].encode(t)
        at = [bytes(coded[c] for c in coder.id_to_token(i)) for i in a]
        bt = [b_bytes[i] for i in b]
        if not b"".join(at) == b"".join(bt) == f" {t}".encode():
            yield [], [], [], []
            continue
        spans = lambda ts: list(zip(np.r_[0, np.cumsum([len(x) for x in ts])].tolist(), np.cumsum([len(x) for x in ts]).tolist(), strict=False))
        sa, sb = spans(at), spans(bt)
        links, j = [], 0
        for x, (s, e) in zip(a, sa, strict=True):
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((x, b[k]))
                k += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, i, j = [], 0, 0
        for c in cuts:
            own, other = [], []
            while i < len(a) and sa[i][1] <= c:
                own.append(str(a[i]))
                i += 1
            while j < len(b) and sb[j][1] <= c:
                other.append(str(b[j]))
                j += 1
            groups.append(",".join(own) + "|" + ",".join(other))
        yield a, b, groups, links


def brute(rows):
    told = list(plain([t for _, t in rows]))
    count = Counter(p for *_, links in told for p in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, told, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(map(str, out))


@pytest.mark.parametrize("block_words", [200, 2_000_000])
def test_odd_texts(spark, block_words):
    """Nulls, every kind of white space, special tokens' strings, texts that a tokenizer changes, long ones, repeated rows and clashing names."""
    rows = [*enumerate(ODD), (3, ODD[3]), (3, ODD[3]), (None, "no number"), (4, "another text of the same number")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, block string").repartition(3)
    got = alignment.align(df, *token_files(), block_words)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)
    assert alignment.align(df.where("doc_id = -1"), *token_files()).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_alignment"](spark, sf).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_words_are_whole(spark):
    """What the split by words rests on: random texts of white space, letters and marks give the same tokens in one piece."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice([" ", " ", "  ", "\n", "\t", "a", "Be", "the", "9", "12", ".", "'s", "é", "▁", "日", " ", "'"]) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *token_files(), 500).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


@pytest.mark.parametrize("docs", [1, 15, 16, 17, 300])
def test_planes(docs):
    rng = np.random.default_rng(docs)
    entries = sorted({(int(p), int(d)) for p, d in zip(rng.zipf(1.3, 4000) % 50, rng.integers(0, docs, 4000), strict=True)})
    pair, doc = (np.array(x) for x in zip(*entries, strict=True))
    times = rng.zipf(1.5, len(pair)) % 40 + 1
    keys, n, bits = alignment.packed(pair, doc, times, docs)
    found = Counter()
    for b, at in ((bits.slice(0, 3), 0), (bits.slice(3), 3)):
        for plane, row, who in alignment.unpacked(b, docs):
            for r, d in zip((row + at).tolist(), who.tolist(), strict=True):
                found[int(keys[r]), d] += 1 << plane
    assert found == {(int(p), int(d)): int(t) for p, d, t in zip(pair, doc, times, strict=True)}
    assert n.tolist() == [sum(p == k for p, _ in entries) for k in keys]
    assert isinstance(bits, pa.BinaryArray)
