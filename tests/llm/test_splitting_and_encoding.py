"""Splitting against its definition; encoding and joining against encoding whole; mixing against its targets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import boundary_split, encode, mixing

SPACE = " \t\r\n"
LEVELS = {
    "paragraph": r"[ \t\r\n]*\n[ \t\r\n]*\n[ \t\r\n]*",
    "line": r"[ \t\r\n]*\n[ \t\r\n]*",
    "sentence": r"(?<=[.!?])[ \t\r\n]+|[ \t\r]*\n[ \t\r\n]*",
    "word": r"[ \t\r\n]+",
}


def test_splitting_keeps_its_promises():
    rng = random.Random(1)
    for _ in range(2500):
        kinds = rng.sample([" ", "\n", "\n\n", ". ", "word", "x" * 600, "ab cd", "\r\n", " \t", "hello!", " what? ", "日本", "\xa0"], 6)
        text = "".join(rng.choice(kinds) for _ in range(rng.randint(0, 300)))
        limit, overlap = rng.choice([(30, 8), (64, 0), (512, 64)])
        kind, pieces = boundary_split.split_text(text, limit, overlap)
        body = text.strip(SPACE)
        at = 0
        for content, start, shared, _ in pieces:
            assert 0 < len(content) <= limit and content == content.strip(SPACE) and text[start : start + len(content)] == content and 0 <= shared <= overlap
            assert start <= at or not text[at:start].strip(SPACE)
            at = start + len(content)
        assert not text[at:].strip(SPACE)
        if len(body) <= limit:
            assert kind is None and len(pieces) == bool(body)
            continue
        want = next((n for n, p in LEVELS.items() if max(len(x.strip(SPACE)) for x in re.split(p, body)) <= limit), "none")
        assert kind == want and len(pieces) > 1
        if kind != "none":
            assert all(cut != "none" for *_, cut in pieces[1:])


def test_splitting_is_balanced_and_overlaps():
    text = " ".join(f"word{i:04d}." for i in range(400))
    _, pieces = boundary_split.split_text(text)
    sizes = [len(p[0]) - p[2] for p in pieces]
    assert max(sizes) - min(sizes) <= 64 and all(30 <= p[2] <= 64 for p in pieces[1:]) and {p[3] for p in pieces[1:]} == {"sentence"}


def test_splitting_a_table(spark):
    df = spark.createDataFrame([(1, "a" * 600, 5), (2, None, 5), (3, " ", 5), (4, "short", 5)], "rec_id long, page_content string, chunk_index int")
    rows = boundary_split.split_at_boundaries(df, "rec_id", "page_content").orderBy("rec_id", "chunk_index").collect()
    assert [(r["rec_id"], r["chunk_index"], r["boundary"]) for r in rows] == [(1, 0, "none"), (1, 1, "none"), (4, 0, None)]
    assert boundary_split.split_at_boundaries(df.limit(0), "rec_id", "page_content").count() == 0
    with pytest.raises(ValueError):
        boundary_split.split_at_boundaries(df, "rec_id", "page_content", 10, 10)


POOL = ["the ", "a", "  ", "\n", "é", "ß", "日本", "123", "4567", "!!", "don't", "'s", " we'll", "😀", "́", "x" * 50, " " * 30, "<|endoftext|>", "\t\t", "...", "aaaaaa", "ab", "0"]


def random_texts(n, seed, length=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kinds = rng.sample(POOL, rng.choice([2, 4, len(POOL)]))
        out.append("".join(rng.choice(kinds) for _ in range(rng.randint(1, length))))
    return out


def test_joined_parts_equal_the_whole():
    enc = encode.encoder()
    for k, text in enumerate(random_texts(3000, 2)):
        parts = [(enc.encode_ordinary(p), safe) for p, safe in encode.halves(text, (5, 16, 40)[k % 3])]
        assert encode.join_tree(parts, enc) == enc.encode_ordinary(text)


def test_ids_equal_another_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{encode.VOCABULARIES}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in random_texts(500, 3):
        assert encode.encoder().encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids


def test_encoding_a_table(spark):
    enc = encode.encoder()
    texts = {1: "Hello  world ", 2: None, 3: "", 4: " \n", 5: "word " * 3000, 6: "x" * 20000, 7: "日本" * 4000}
    df = spark.createDataFrame([(k, t, "z") for k, t in texts.items()], "doc_id long, text string, id string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_texts(df, "doc_id", "text", leaf=1000).collect()}
    assert got == {k: enc.encode_ordinary(t) if t else [] for k, t in texts.items()}
    counts = {r["doc_id"]: r["tokens"] for r in encode.count_tokens(df, "doc_id", "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert encode.encode_texts(df.limit(0), "doc_id", "text").count() == 0


@pytest.fixture(scope="module")
def mix(spark):
    rng = random.Random(4)
    docs = []
    for i in range(600):
        feed = rng.choice([" A ", "a", "A", "b", "c", "other", None]) if i > 300 else "a"
        docs.append((i, " ".join(f"t{rng.randrange(5000)}" for _ in range(rng.randint(3, 30))), feed))
    docs += [(None, "no id", "a"), (900, docs[5][1], "b"), (901, None, "a"), (902, "", "b"), (903, docs[7][1], "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("A", 0.3, 1), ("b", 0.3, 4), (" C", 0.3, 3), ("none", 0.1, 2)], "source string, weight double, max_repeats int")
    return df, targets, mixing.distinct_texts(df, targets, "doc_id", "text", "source")


def test_texts_count_once_and_for_the_first_feed(mix):
    _, _, sizes = mix
    rows = {r["id"]: r["feed"] for r in sizes.collect()}
    assert not {900, 901, 902, 903} & set(rows) and set(rows.values()) == {"a", "b", "c"}


def test_shares_repeats_and_order(mix):
    _, targets, sizes = mix
    plan = mixing.plan_mix(sizes, targets)
    order = mixing.training_order(sizes, plan, slice_rows=20)
    rows = order.collect()
    assert [r["time"] for r in rows] == sorted(r["time"] for r in rows) and all(0 <= r["time"] <= 1 for r in rows)
    uses = {}
    for r in rows:
        uses.setdefault((r["id"], r["feed"]), []).append(r["use"])
    most = {"a": 1, "b": 4, "c": 3}
    assert all(sorted(u) == list(range(1, len(u) + 1)) and len(u) <= most[f] for (_, f), u in uses.items())
    got = {r["feed"]: r for r in mixing.shares(order, plan).collect()}
    assert set(got) == {"a", "b", "c", "none"} and got["none"]["share"] == 0
    assert all(abs(got[f]["share"] - 1 / 3) < 0.01 for f in "abc")


def test_schedule_follows_the_tilt(mix):
    _, targets, sizes = mix
    plan = mixing.plan_mix(sizes, targets, tilt=0.9)
    tilts = {r["feed"]: (r["tilt"], r["demand"]) for r in plan.collect()}
    total = sum(d for _, d in tilts.values())
    assert abs(sum(t * d for t, d in tilts.values()) / total) < 1e-9
    order = mixing.training_order(sizes, plan).groupBy("feed").agg((F.sum(F.col("time") * F.col("tokens")) / F.sum("tokens")).alias("mean")).collect()
    for r in order:
        assert abs(r["mean"] - (0.5 + tilts[r["feed"]][0] / 6)) < 0.03


@pytest.mark.parametrize("wishes", [{"a": 0.8, "b": -0.8, "c": 0.0}, {"a": 1.0, "b": -1.0, "c": -1.0}, {"a": None, "b": 0.9, "c": None}])
def test_feeds_may_have_schedules_of_their_own(mix, wishes):
    _, targets, sizes = mix
    feed = mixing.feed_name("source")
    wish = F.coalesce(*[F.when(feed == k, F.lit(v).cast("string")) for k, v in wishes.items()])
    plan = mixing.plan_mix(sizes, targets.withColumn("schedule", wish), tilt=0.0)
    tilts = {r["feed"]: (r["tilt"], r["demand"]) for r in plan.collect()}
    total = sum(d for _, d in tilts.values())
    assert abs(sum(t * d for t, d in tilts.values()) / total) < 1e-9 and all(abs(t) <= 1 + 1e-9 for t, _ in tilts.values())
    known = {k: v or 0.0 for k, v in wishes.items()}
    assert sorted(known, key=known.get) == sorted(known, key=lambda k: (tilts[k][0], known[k])) or known["b"] == known["c"]
    order = mixing.training_order(sizes, plan).groupBy("feed").agg((F.sum(F.col("time") * F.col("tokens")) / F.sum("tokens")).alias("mean")).collect()
    assert len(order) == 3 and all(abs(r["mean"] - (0.5 + tilts[r["feed"]][0] / 6)) < 0.03 for r in order)


def test_a_given_total_and_no_texts(spark, mix):
    _, targets, sizes = mix
    plan = mixing.plan_mix(sizes, targets, total=10**9)
    assert all(r["demand"] == r["available"] * r["max_repeats"] for r in plan.collect())
    empty = mixing.plan_mix(sizes.limit(0), targets)
    assert {r["demand"] for r in empty.collect()} == {0.0}
    assert mixing.shares(mixing.training_order(sizes.limit(0), empty), empty).count() == 4
