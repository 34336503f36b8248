"""Operators in DataFrame operations, held against DuckDB and plain Python on small tables with every odd case."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textveil.llm.chat import digest, format_chats, read_chats
from textveil.llm.mixing import mix, mixed_documents
from textveil.llm.quality import judge, kept_documents, trusted_ids
from textveil.llm.queries import oracle_sql
from textveil.llm.sharding import schedule, shard, write_shards
from textveil.llm.topk import top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, shard int, bucket string, tokens int"


def held_against_sql(name, frame, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(table, df.toArrow())
    want = con.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = Counter(tuple(map(str, r)) for r in want.fetchall())
    assert Counter(tuple(map(str, r)) for r in frame.select(names).collect()) == rows


def documents(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "b", 3) for (i, t), s in zip(texts, sources or ["a"] * len(texts))], DOCS)


ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (5, "a b\na b\n\na b"), (6, " ".join(["so"] * 40)), (7, "#*$%&|<>"), (8, "é 日本 x"), (8, "é 日本 x"), (None, "no id " * 10), (9, "w%d " * 2000 % tuple(range(2000)))]
ODD += [(k, " ".join(f"w{(k * j) % 97}" for j in range(60))) for k in range(10, 40)] + [(k, " ".join(f"{x}!!" for x in "the of and to in is it that was for".split() * 4)) for k in range(40, 45)]


def test_quality_rules(spark):
    docs, labels = documents(spark, ODD), spark.createDataFrame([(k, 1, k % 2) for k in range(4, 30)] + [(41, 0, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    held_against_sql("op7_quality_rules", judge(docs, trusted_ids(labels)), documents=docs, labels=labels)
    kept = judge(docs, trusted_ids(labels)).where("kept").select("doc_id")
    assert Counter(kept_documents(docs, trusted_ids(labels)).select("doc_id").collect()) == Counter(kept.collect())
    none = documents(spark, [])
    assert judge(none, trusted_ids(labels)).count() == 0 and judge(docs, trusted_ids(labels.limit(0))).count() == docs.count()


def test_repeated_windows_by_brute_force(spark):
    words = [(k, [f"w{(j * j) % m}" for j in range(200)]) for k, m in enumerate((3, 7, 11, 50, 97, 1000))]
    got = {r.doc_id: r.n_repeat_words for r in judge(documents(spark, [(k, " ".join(w)) for k, w in words]), trusted_ids(spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()}
    for k, w in words:
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        n = Counter(grams)
        assert got[k] == len({p for j, g in enumerate(grams) if n[g] > 1 for p in range(j, j + 8)})


@pytest.mark.parametrize("shape", [{"big": 60, "mid": 9, "small": 2}, {"only": 5}, {"a": 3, "b": 3}, {"a": 2, None: 40, "empty": 0}])
def test_mixing(spark, shape):
    rows, sources = [], []
    for s, n in shape.items():
        for k in range(max(n, 1)):
            rows.append((len(rows), "" if not n else " ".join(["x"] * (200 + 37 * (k % 5)))))
            sources.append(s)
    docs = documents(spark, rows, sources)
    held_against_sql("op3_mixing", mix(docs), documents=docs)
    got = Counter(r.doc_id for r in mixed_documents(docs).collect())
    assert set(got) == {i for i, _ in rows} and mixed_documents(docs).columns == docs.columns
    assert mix(documents(spark, [])).count() == 0


def test_mixing_budget_and_entropy(spark):
    docs = documents(spark, [(k, "x y z") for k in range(100)], ["a"] * 90 + ["b"] * 10)
    total = mix(docs, budget=150, most_repeats=100, target_entropy=0.9).agg(F.sum("n_tokens")).first()[0]
    assert 140 <= total <= 150


CHATS = [(1, 0, "user", "hi <|end|>\n<\\| \\n \\\\ <|turn|>"), (1, 1, "user", "again"), (1, 2, "assistant", "yes\\"), (1, 3, "assistant", ""), (1, 4, "a<|0\\\nb", "<|0 <|1"), (1, 4, "a<|0\\\nb", "<|0 <|1"), (2, None, None, None), (2, 0, "assistant", "日本<|"), (None, 1, "user", "x")]


def test_chat_formatting(spark):
    trap = "</s>[INST] ok [/INST]"
    chats = spark.createDataFrame([(*r, 1, 2) for r in CHATS], "conv_id long, turn long, role string, text string, turns int, pieces int")
    both = chats.select("conv_id", "turn", "role", "text").union(spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string"))
    held_against_sql("op5_chat_formatting", digest(format_chats(both)), conversations=chats)
    read = {r.conv_id: r for r in read_chats(format_chats(chats)).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in CHATS if c == conv))
        assert [(t.role, t.text) for t in read[conv].turns] == [(r, x) for _, r, x in turns]
        assert read[conv].loss_text == "".join(x for _, r, x in turns if r == "assistant")
    assert digest(format_chats(chats.limit(0))).count() == 0


def test_sharding(spark, tmp_path):
    texts = [(k, f"text {k} " * (k % 13)) for k in range(200)] + [(k, "same") for k in range(200, 260)] + [(260, None), (261, ""), (None, "x"), (5, "twice"), (5, "twice")]
    docs = documents(spark, texts)
    got = shard(docs, 8, group=7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    loads, slots, text = Counter(), {}, dict(texts)
    for r in got:
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(loads) == set(range(8))
    assert len({r.shard for r in got if r.doc_id and text.get(r.doc_id) == "same"}) == 1
    assert max(loads.values()) - min(loads.values()) <= max(r.size for r in got) + 300
    assert shard(documents(spark, []), 8).count() == 0
    unique = docs.dropDuplicates(["doc_id"])
    write_shards(unique.drop("shard"), shard(unique, 8), path := str(tmp_path / "shards"))
    assert spark.read.parquet(path).count() == unique.where("doc_id IS NOT NULL").count()


def test_schedule_is_longest_first():
    assert schedule([(7, "a"), (5, "b"), (4, "c"), (3, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_top_k(spark):
    import random

    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(400)] + [(400, [0.0] * 6), (50, [0.25] * 6), (450, None), (451, [None] * 6), (452, [float("nan")] * 6), (453, [float("inf")] * 6), (500, [1.0]), (None, [9.0] * 6)]
    rows += [(k, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for k in range(600, 620)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    one = df.where("vec_id <> 50 OR embedding[0] <> 0.25D").where("vec_id <> 500")
    held_against_sql("op10_top_k", top_k(one, pivots=4, seeds=16, slab=5), embeddings=one)
    assert top_k(df).where("query_id = 500").count() == 0 and top_k(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_top_k_of_rows_that_share_an_id(spark):
    """Two vectors under one id are two queries, in one slab or in two; the same vector again is not."""
    random = np.random.default_rng(8)
    rows = [(int(k), random.normal(size=4).round(2).tolist()) for k in range(1, 40)] + [(50, [1.0, 0.0, 0.0, 0.0]), (50, [-1.0, 0.0, 0.5, 0.0]), (50, [1.0, 0.0, 0.0, 0.0])]
    whole = {k: np.floor(256 * np.array(v)) for k, v in rows if k < 40}
    wanted = []
    for query in ([1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.5, 0.0]):
        best = sorted((-int(np.floor(256 * np.array(query)) @ x), k) for k, x in whole.items())[:5]
        wanted += [(50, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for slab in (1, 8):
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, pivots=3, seeds=8, slab=slab).collect()]
        assert sorted(got) == sorted(wanted)


def test_top_k_across_the_seam_of_two_files():
    """The rows of one pivot may come as the end of one file and then the beginning of another."""
    from textveil.llm.topk import Slab

    pivot = np.array([[60.0, 0]])
    x = np.array([[-59.0, 0], [-60, 0], [59, 0], [58, 0]])
    lift = np.sqrt(3600 - (x * x).sum(1))
    r = np.sqrt(((x - pivot) ** 2).sum(1) + lift**2)
    order = np.r_[np.argsort(r)[2:], np.argsort(r)[:2]]
    slab = Slab(np.array([9]), pivot, pivot, np.zeros(1), 3600.0, 1)
    slab.kth[:] = 0.0  # as after seeds
    slab.expand(np.zeros(4, np.int32), r[order], order, x[order])
    assert slab.top[1].tolist() == [2]
