import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import token_alignment as t
from lodestone.llm._tokenizer import tokenizer_path

A, B = tokenizer_path(t.BYTE_BPE), tokenizer_path(t.PIECE_BPE)


def whole(texts):
    """Tokens of each text with their bytes, by one call of each library on the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = {}
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for x in range(256):
        shown[chr(x) if x in kept else chr(256 + [y for y in range(256) if y not in kept].index(x))] = x
    assert ByteLevel().decode([a.id_to_token(262)]) == bytes(shown[c] for c in a.id_to_token(262)).decode()
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        x = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        same = b"".join(w for _, w in x) == b"".join(w for _, w in y) == (" " + text).encode()
        out.append((x, y) if same else ([], []))
    return out


def brute(texts):
    docs = []
    for x, y in whole(texts):
        at, ends = [], []
        for side in (x, y):
            stops = np.cumsum([len(w) for _, w in side]).tolist()
            ends.append(stops)
            at.append([(i, e - len(w), e) for (i, w), e in zip(side, stops)])
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, taken = [], [0, 0]
        for c in cuts:
            sides = []
            for k in (0, 1):
                to = ends[k].index(c, taken[k]) + 1
                sides.append(",".join(str(i) for i, _, _ in at[k][taken[k] : to]))
                taken[k] = to
            groups.append("|".join(sides))
        links = []
        j = 0
        for i, s, e in at[0]:
            while j and at[1][j - 1][2] > s:
                j -= 1
            while j < len(at[1]) and at[1][j][1] < e:
                if at[1][j][2] > s:
                    links.append((i, at[1][j][0]))
                j += 1
        docs.append((len(x), len(y), groups, links))
    counts = Counter(p for d in docs for p in set(d[3]))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    return [
        (na, nb, len(g), len(links), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "", sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links)) for na, nb, g, links in docs
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
ODD = [None, "", " ", "  ", "\n", "\n\n", "a", " a", "a ", "a\n", "\na", "a\nb", "a \nb", "a\n b", "a\t b\r\nc", "x▁y", "▁", "<s> </s> <0x0A> <unk> <|endoftext|>", "it's we'll 'tis", "é é ﬁ", "a\x00b \x1c c", "nb sp 　 wide　 x", "日本語 のテキスト。\n\n次の行", "🙂🙂 ok 👩‍👩‍👧", "١٢٣ 456.78,9", "a b c " * 50, "x" * 5000, "a  b   c\n\n\nd"]


def test_every_row_against_whole_encoding(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(ODD + ODD)] + [(None, "a null id"), (None, "a null id")], "doc_id bigint, text string")
    docs = docs.unionByName(odd).withColumn("block", F.lit("x")).withColumn("n_a", F.lit(1)).repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute([text for _, text in rows])))
    got = sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in t.aligned(docs).collect())
    assert got == want
    zeros = [r for r in want if r[1] == 0]
    assert all(r[1:] == (0, 0, 0, 0, "", 0, 0) for r in zeros) and len(zeros) < 20


def test_empty_table_and_groups(spark):
    docs = spark.createDataFrame([(1, "Hello wörld"), (2, None), (3, "x▁")], "doc_id bigint, text string")
    assert t.aligned(docs.limit(0)).count() == 0
    assert t.aligned(docs.where("doc_id = 2")).collect()[0].n_a == 0
    got = {r.doc_id: r.groups for r in t.groups(docs).collect()}
    assert got[2] == got[3] == []
    (x, y) = whole(["Hello wörld"])[0]
    assert [i for g in got[1] for i in g.a_ids] == [i for i, _ in x] and [i for g in got[1] for i in g.b_ids] == [i for i, _ in y]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sté. \n\t\r 　,1日🙂▁"), max_size=30), min_size=1, max_size=8))
def test_units_never_change_tokens(texts):
    p = t.pair(A, B)
    names, index, offsets = p.units(pa.array(texts, pa.string()))
    a, b = p.encoded(names) if names else ([], [])
    for text, i, j in zip(texts, offsets, offsets[1:]):
        words = index[i:j].tolist()
        assert "".join(names[k] for k in words) == (" " + text if text else "")
        if text:
            assert [x for k in words for x in a[k]] == p.a.encode(" " + text, add_special_tokens=False).ids
            if "▁" not in text:
                assert [x for k in words for x in b[k]] == p.b.encode(text)


def test_coalescing_of_any_intervals():
    a, b = t.coalesced(np.array([0, 4, 9]), np.array([3, 8, 12]), np.array([2, 8, 20]), np.array([5, 9, 21]))
    assert a.tolist() == [0, 0, 2] and b.tolist() == [0, 1, 3]
    x, y = t.overlaps(np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 4]), np.array([4, 9]))
    assert list(zip(x.tolist(), y.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1)]


def test_a_block_is_a_row_group(spark):
    import pyarrow.parquet as pq

    # texts longer than a block, from one task
    rows = [(i, f"{i} some words. " * (t.BLOCK // 10)) for i in range(3)]
    written = t.blocks(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written.inputFiles()]
    assert sum(f.num_rows for f in files) == 3 and all(f.num_row_groups == f.num_rows for f in files)
