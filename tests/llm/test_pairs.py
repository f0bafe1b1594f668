"""Near-duplicate join and history de-duplication against brute force, with hot groups and dirty rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import history_dedup, ngram_join
from lectern.llm import shingles as S

WORD = re.compile(r"[^\W_]+")


def shingle_set(text, width):
    w = WORD.findall((text or "").lower())
    return frozenset(zip(*(w[i:] for i in range(width)))), len(w)


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus(n, seed=1, words=40, vocabulary=300):
    """Texts with exact copies, small edits, reordering, dirty rows and ties."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(words)] for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = f"e{rng.randrange(50)}"
        if rng.random() < 0.1:
            t = t[10:] + t[:10]
        sep = rng.choice([" ", "  ", ", ", "\n"])
        out.append((i, sep.join(t).upper() if rng.random() < 0.1 else sep.join(t)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two three"), (n + 4, "?!")]


def truth(rows, width, threshold, least):
    sets = {i: shingle_set(t, width) for i, t in rows}
    ids = [i for i, (s, n) in sets.items() if n >= max(least, width)]
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if likeness(sets[a][0], sets[b][0]) >= threshold - 1e-12}


@pytest.mark.parametrize(("width", "threshold", "least"), [(3, 0.7, 20), (5, 0.8, 0), (2, 0.5, 3)])
def test_join_equals_brute_force(spark, width, threshold, least):
    rows = corpus(240)
    dirty = [(None, rows[0][1], "x", "y"), (None, None, None, None)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows] + dirty, "k long, content string, row string, a string")
    pairs, classes = ngram_join.similar_pairs(df, "k", "content", width, threshold, least)
    got = [(r["row_a"], r["row_b"]) for r in ngram_join.row_pairs(pairs, classes).collect()]
    assert len(got) == len(set(got)) and set(got) == truth(rows, width, threshold, least)


def test_hot_shingles_are_split_without_a_loss(spark):
    tail = " ".join(f"same{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} c{i} {tail} d{i % 5}") for i in range(120)]
    df = spark.createDataFrame(rows, "k long, content string").repartition(5)
    pairs, classes = ngram_join.similar_pairs(df, "k", "content", 3, 0.7, 20, hot=16, fragments=3)
    got = {(r["row_a"], r["row_b"]) for r in ngram_join.row_pairs(pairs, classes).collect()}
    assert got == truth(rows, 3, 0.7, 20) and len(got) == 120 * 119 // 2


def test_counts_as_codes_never_saturate():
    counts = np.unique(np.concatenate([np.arange(9000), np.random.default_rng(1).integers(0, 2**41, 2000), 2 ** np.arange(42)]))
    codes = ngram_join.as_code(counts)
    back = ngram_join.as_count(codes)
    assert (back >= counts).all() and (back[counts < 4096] == counts[counts < 4096]).all() and ((back - counts) <= counts / 2000).all()
    assert (np.diff(codes.astype(int)) >= 0).all()  # the order stays


def test_counters_are_summed_in_steps_and_beyond_16_bits(spark):
    texts = spark.range(70_000).repartition(9).selectExpr("'a b c' || if(id % 7 = 0, ' d' || id, '') AS text")
    codes = ngram_join.shingle_counters(texts, "text", 3, 0, 16, fan=2)
    counts = ngram_join.as_count(codes)
    assert 70_000 <= counts.max() <= 70_000 * 1.002 and codes.dtype == np.dtype("<u2")


@pytest.mark.parametrize("hot", [3, 10**6])
def test_first_of_copies_with_a_hot_print(spark, hot, monkeypatch):
    monkeypatch.setattr(S, "HOT_PRINTS", hot)
    rows = spark.createDataFrame([(i, 1 if i % 3 else i, 5) for i in range(60)], "row long, p0 long, p1 long")
    got = {tuple(r) for r in S.first_of_copies(rows).collect()}
    assert got == {(i, 1, 41) if i % 3 or i == 1 else (i, i, 1) for i in range(60)} or got == {(i, 1, 40) if i % 3 else (i, i, 1) for i in range(60)}


def test_short_texts_with_few_shingles(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, "A, b. C!"), (4, "a b c d"), (5, "x y z"), (6, "a b")]
    pairs, classes = ngram_join.similar_pairs(spark.createDataFrame(rows, "k long, content string"), "k", "content", 3, 0.5)
    assert {(r["row_a"], r["row_b"]) for r in ngram_join.row_pairs(pairs, classes).collect()} == truth(rows, 3, 0.5, 0)


def test_groups_and_links(spark):
    rows = corpus(150, 4)
    pairs, classes = ngram_join.similar_pairs(spark.createDataFrame(rows, "k long, content string"), "k", "content", 3, 0.7, 20)
    got = {r["row"]: (r["group"], r["links"]) for r in ngram_join.near_duplicate_groups(pairs, classes).collect()}
    near = {i: set() for i in got}
    for a, b in truth(rows, 3, 0.7, 20):
        near[a].add(b)
        near[b].add(a)
    for i, (group, links) in got.items():
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (group, links) == (min(seen), len(near[i]))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, content string, b int")
    pairs, classes = ngram_join.similar_pairs(empty, "k", "content")
    assert ngram_join.row_pairs(pairs, classes).count() == 0 and ngram_join.near_duplicate_groups(pairs, classes).count() == 0
    assert history_dedup.repeated_rows(empty, "b", "k", "content").count() == 0


def greedy(rows, width, threshold, least):
    accepted, cases = [], set()
    for b, i, t in sorted(rows, key=lambda r: r[:2]):
        s, n = shingle_set(t, width)
        if n < max(least, width):
            continue
        if any(likeness(s, o) >= threshold - 1e-12 for o in accepted):
            cases.add(i)
        else:
            accepted.append(s)
    return cases


@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 2, 3, 5, 8]), i, t) for i, t in corpus(240, seed)]
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(None, 1, rows[0][2], 0), (1, None, rows[0][2], 0)], "b int, k long, content string, at int").repartition(5)
    got = history_dedup.repeated_rows(df, "b", "k", "content", width=3, threshold=0.7, min_words=20).collect()
    want = greedy(rows, 3, 0.7, 20)
    found = [r["row"] for r in got]
    assert len(found) == len(set(found)) and set(found) == want
    text = {i: shingle_set(t, 3)[0] for _, i, t in rows}
    assert all(likeness(text[r["row"]], text[r["of"]]) >= 0.7 - 1e-12 or r["of"] in want for r in got)


def test_a_hot_group_of_small_edits(spark):
    base = [f"w{k}" for k in range(40)]
    rng = random.Random(5)
    rows = []
    for i in range(150):
        t = list(base)
        t[rng.randrange(40)] = f"e{i}"
        rows.append((1 + i // 50, i, " ".join(t)))
    got = history_dedup.repeated_rows(spark.createDataFrame(rows, "b int, k long, content string"), "b", "k", "content", width=3, threshold=0.7, min_words=20)
    assert {r["row"] for r in got.collect()} == greedy(rows, 3, 0.7, 20)


def held_rows(forest):
    return {int(a) for r in forest.runs().collect() for a in np.frombuffer(r["entries"], history_dedup.ENTRY)["at"]}


def test_forest_is_read_again_and_merged(spark, tmp_path):
    rows = corpus(120, 7)
    settings = {"width": 3, "threshold": 0.7, "min_words": 20, "max_runs": 1}
    everything = spark.createDataFrame(rows, "at long, text string")
    cases = set()
    for lo, hi in ((0, 40), (40, 80), (80, 200)):
        forest = history_dedup.HashForest(spark, str(tmp_path / "forest"), **settings)
        cases |= {r["at"] for r in forest.add(everything.filter(f"at >= {lo} and at < {hi}"), everything.filter(f"at < {hi}")).collect()}
    assert cases == greedy([(1, i, t) for i, t in rows], 3, 0.7, 20)
    assert len(forest._runs) == 1 and held_rows(forest) == {i for i, t in rows if shingle_set(t, 3)[1] >= 20} - cases


def test_a_forest_keeps_its_settings(spark, tmp_path):
    rows = corpus(120, 3)
    everything = spark.createDataFrame(rows, "at long, text string")
    settings = {"width": 3, "threshold": 0.7, "min_words": 20}
    first = history_dedup.HashForest(spark, str(tmp_path / "forest"), buckets=7, **settings)
    cases = {r["at"] for r in first.add(everything.filter("at < 60"), everything).collect()}
    for other in ({"buckets": 23}, {"threshold": 0.8}, {"width": 4}, {"trees": 8}):
        with pytest.raises(ValueError, match="other settings"):
            history_dedup.HashForest(spark, str(tmp_path / "forest"), **(settings | other))
    again = history_dedup.HashForest(spark, str(tmp_path / "forest"), **settings)
    assert again.buckets == 7
    cases |= {r["at"] for r in again.add(everything.filter("at >= 60"), everything).collect()}
    assert cases == greedy([(1, i, t) for i, t in rows], 3, 0.7, 20)


def test_a_small_batch_reads_few_slots_and_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(25))) for i in range(1500)]
    rows += [(1500, rows[100][1] + " more")]
    everything = spark.createDataFrame(rows, "at long, text string")
    forest = history_dedup.HashForest(spark, str(tmp_path / "forest"), width=3, threshold=0.7, min_words=20, buckets=32, block=16)
    assert forest.add(everything.filter("at < 1500"), everything).count() == 0
    read, runs = [], forest.runs
    monkeypatch.setattr(forest, "runs", lambda slots=None: read.append(slots) or runs(slots))
    got = {tuple(r) for r in forest.add(everything.filter("at >= 1500"), everything).collect()}
    assert got == {(1500, 100)}
    files, some = runs().inputFiles(), runs(read[0]).select("slot").distinct().count()
    assert len(read[0]) <= 16 and some <= 0.05 * 16 * 32 and len(files) >= some
    plan = runs(read[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slot" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_alike_rows_of_one_group_leave_one_in_history(spark, monkeypatch):
    base = [f"w{k}" for k in range(40)]
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        t = list(base)
        t[rng.randrange(40)] = f"e{i}"
        rows.append((1 + (i >= 1500), i, " ".join(t)))
    df = spark.createDataFrame(rows, "b int, k long, content string").repartition(3)
    pairs = []
    measure = S.with_likeness
    monkeypatch.setattr(S, "with_likeness", lambda p, *rest: pairs.append(p.count()) or measure(p, *rest))
    got = {r["row"] for r in history_dedup.repeated_rows(df, "b", "k", "content", width=3, threshold=0.7, min_words=20).collect()}
    assert got == greedy(rows, 3, 0.7, 20) and len(got) >= 2990
    assert sum(pairs) < 25 * len(rows)  # all pairs would be 4.5 million


def test_without_the_sketch_nothing_is_dropped_before_verification(spark, tmp_path):
    rows = corpus(150, 9)
    everything = spark.createDataFrame(rows, "at long, text string")
    forest = history_dedup.HashForest(spark, str(tmp_path / "forest"), width=3, threshold=0.7, min_words=20, exact_sketch=True)
    assert forest.floor == 0
    assert {r["at"] for r in forest.add(everything, everything).collect()} == greedy([(1, i, t) for i, t in rows], 3, 0.7, 20)


def test_buckets_cut_no_subtree(spark, tmp_path):
    rows = corpus(150, 8)
    everything = spark.createDataFrame(rows, "at long, text string")
    forest = history_dedup.HashForest(spark, str(tmp_path / "forest"), width=3, threshold=0.7, min_words=20, buckets=23)
    assert {r["at"] for r in forest.add(everything, everything).collect()} == greedy([(1, i, t) for i, t in rows], 3, 0.7, 20)


def test_arrivals_double():
    sizes = {1: 9, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 2, 8: 50}
    assert history_dedup.arrivals(sizes) == [[1], [2, 3, 4, 5, 6], [7, 8]] and history_dedup.arrivals({}) == []


def test_prefix_length_meets_the_recall():
    d = history_dedup.depth_for(0.7, 16, 0.995)
    assert 1 - (1 - 0.7**d) ** 16 >= 0.995 > 1 - (1 - 0.7 ** (d + 1)) ** 16


def test_shingle_sets_equal_python():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "B", "c1", "é", "x_y", "-"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, ""]
    hashes, size = S.shingle_sets(*S.word_hashes(texts), 3)
    assert size.tolist() == [len(shingle_set(t, 3)[0]) for t in texts] and len(hashes) == size.sum()
    left, right = texts[:150], texts[150:300]
    want = [likeness(shingle_set(a, 3)[0], shingle_set(b, 3)[0]) for a, b in zip(left, right)]
    assert np.allclose(S.pair_likeness(left, right, 3), want)


def test_links_to_history_are_limited_while_they_are_found(monkeypatch):
    monkeypatch.setattr(history_dedup, "PAIRS_AT_ONCE", 500)
    old, new = np.zeros(300, history_dedup.ENTRY), np.zeros(40, history_dedup.ENTRY)
    old["at"], new["at"] = np.arange(300), 1000 + np.arange(40)
    old["sketch"], new["key"][20:] = (np.uint64(1) << (np.arange(300) % 3).astype(np.uint64)), 1 << 59
    later, earlier, alike, more = history_dedup.located(new, old, 3, 10, 4)
    assert list(later) == [1000 + k for k in range(20) for _ in range(4)] and list(earlier) == [0, 1, 2, 3] * 20
    assert set(alike) == {63} and list(more) == list(range(1000, 1020))


def test_subtrees_over_many_blocks_and_runs_without_cases(spark):
    rows = corpus(240, 7)
    df = spark.createDataFrame([(i // 80 + 1, i, t) for i, t in rows], "batch int, row long, content string")
    want = {r["row"] for r in history_dedup.repeated_rows(df, "batch", "row", "content", width=3, threshold=0.7, min_words=20).collect()}
    texts = df.select(history_dedup.position("batch", "row").alias("at"), F.col("content").alias("text"))
    forest, got, low = history_dedup.HashForest(spark, width=3, threshold=0.7, min_words=20, buckets=2, block=4), set(), (1 << history_dedup.ROW_BITS) - 1
    for batch in (1, 2, 3, 4):
        found = forest.add(texts.filter(F.shiftright("at", history_dedup.ROW_BITS) == batch), texts)
        got |= {r["at"] & low for r in found.collect()}
    assert got == want == greedy([(i // 80 + 1, i, t) for i, t in rows], 3, 0.7, 20)
    held = {a & low for a in held_rows(forest)}
    assert held and not held & got
    for r in forest.runs().collect():
        keys = np.frombuffer(r["entries"], history_dedup.ENTRY)["key"]
        assert len(keys) <= 4 and (r["lo"], r["hi"]) == (keys[0], keys[-1]) and (np.diff(keys.astype(np.int64)) >= 0).all()


def test_rows_that_may_miss_a_link_are_searched_again():
    new = np.zeros(80, history_dedup.ENTRY)
    new["at"] = np.arange(80)
    new["sketch"][70:79], new["sketch"][79] = ~np.uint64(0), np.uint64(0xFFFFFFFF)
    for leaders in (1, 2, 64):  # rows 0, 70 and 79 lead; only 0 has no row before it
        assert list(history_dedup.linked(new, 3, 50, leaders, 64, 4)[2]) == list(range(1, 80))
    later, earlier, more = history_dedup.linked(new, 3, 50, 1, 80, 100)  # all are compared
    assert len(later) == 70 * 69 // 2 + 9 * 8 // 2 and not len(more)
    assert list(history_dedup.linked(new, 3, 50, 1, 80, 4)[2]) == [*range(5, 70), *range(75, 79)]
    apart = new.copy()
    apart["sketch"] = S.mix(np.arange(80).astype(np.uint64))
    assert not len(history_dedup.linked(apart, 3, 60, 100, 64, 4)[2])  # nothing set aside, nothing missed

