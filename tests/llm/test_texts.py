"""Personal data, quality rules, scanned pages and stuffed pages on small fixtures and held-out labels."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ocr_repair, pii_spans, quality_rules, stuffing

GIVEN = ["Selma", "Viggo", "Tobin", "Ilse"]
COMMON = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "be", "by", "on", "not", "this", "are", "from", "at", "which", "has", "every"]


def pii_corpus(n=400, seed=1):
    rng = random.Random(seed)
    family = ["Crowmarsh", "Solvik", "Dunmorrel", "El-Haddarin", "O'Kerrivan"]
    given = GIVEN + ["Marisol", "Castor"]
    rows, truth = [], set()
    filler = ["The pump was moved to the basement. ", "Order 900122 replaced order 900123. ", "See https://wiki.example/ops/12 for more. ", "Part 90-12-3346 is out of stock. ", "The Willow Street refurbishment cost 3,200 credits. ", "The gateway at 10.0.12.5 listens on port 8080. ", "Version 2.14.3 of 2024-03-01. ", "Kestrel Console is a product. "]
    for i in range(n):
        text = rng.choice(filler)
        for _ in range(rng.randint(0, 2)):
            kind = rng.choice(["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"])
            g, f = rng.choice(given), rng.choice(family)
            before, value = {
                "EMAIL": lambda: rng.choice([("Write to ", f"{g.lower()}.x@mail.example"), ("E-mail: ", f"{g.lower()} (at) post.example"), ("From: ", f"{g.lower()} at post dot example")]),
                "PHONE": lambda: rng.choice([("Tel.: ", f"+44 20 7946 0{rng.randint(100, 999)}"), ("Call ", f"07700 900{rng.randint(100, 999)}"), ("mob ", f"(212) 555-0{rng.randint(100, 199)}")]),
                "ID_NUMBER": lambda: rng.choice([("Please quote SSN ", f"9{rng.randint(10, 99)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"), ("under CNIC no. ", f"00{rng.randint(100, 999)}-0{rng.randint(100000, 999999)}-{rng.randint(0, 9)}"), ("copy shows passport ", f"KZ {rng.randint(100, 999)} {rng.randint(1000, 9999)}")]),
                "ADDRESS": lambda: rng.choice([("Deliver to ", f"{rng.randint(1, 200)} Juniper Street, Norwick"), ("lives at ", f"Flat {rng.randint(1, 30)}, {rng.randint(1, 99)} Mill Pond Road, Wexbury"), ("Anschrift ", f"Lindenweg {rng.randint(1, 200)}, 00011 Altfurt"), ("Livrer au ", f"{rng.randint(1, 99)} rue des Tilleuls, 00051 Valcourt")]),
                "NAME": lambda: rng.choice([("The form goes to Ms ", f"{g} {f}"), ("Signed: ", f"{g[0]}. {f}"), ("claim of Mr ", f"{f.upper()}, {g}"), ("spoke with ", f"{g} {rng.choice('ABC')}. {f}")]),
            }[kind]()
            text += before
            truth.add((i, kind, len(text)))
            text += value + rng.choice([". ", "\n", ". Every valve stays open. "])
        rows.append(("t", i, text))
    return rows, truth


def test_personal_data_is_found_where_it_starts(spark):
    rows, truth = pii_corpus()
    df = spark.createDataFrame(rows + [("t", 9001, None), ("t", 9002, ""), ("t", None, "x@y.example"), (None, 5, "x@y.example"), ("u", 1, "A" * 30000 + " 😀 x@y.example")], "tab string, item long, text string")
    found = pii_spans.find(df, GIVEN).cache()
    got = {(r["item"], r["kind"], r["start"]) for r in found.filter("tab = 't'").collect()}
    assert len(got & truth) / len(truth) > 0.97 and len(got - truth) / max(1, len(got)) < 0.03
    assert [(r["kind"], r["start"]) for r in found.filter("tab = 'u'").collect()] == [("EMAIL", 30003)]
    clean = {(r["tab"], r["item"]): r["text"] for r in pii_spans.redacted(df, found).collect()}
    assert clean[("t", 9001)] is None and clean[("t", 9002)] == "" and clean[("u", 1)].endswith("😀 [EMAIL]")
    assert not any("@mail.example" in (t or "") for t in clean.values())
    assert pii_spans.find(df.limit(0), GIVEN).count() == 0


FORMS = [
    ["12 Mill Pond Road", "Flat 3, 7a Juniper St.", "9 OAK GARDENS", "4 Elm Blvd", "4 Elm Boulevard", "4 Elm Crescent", "4 Elm Gdns", "1 ELM ROW"],
    ["House 12, Street 4", "house no. 12a, block B", "Plot\u00a07, Road 3", "HOUSE\t12, lane 4", "hOUSE 12, Street 4"],
    ["12 bd. Voltaire", "12 bd Voltaire", "3 bis, av. Foch", "3 ter rue\u00a0des Tilleuls", "8 Boulevard Nord"],
    ["Lindenweg 4", "HAUPTSTRASSE 9", "Seestr. 4b", "Auf der Heide 12", "Auf dem Berg 12", "An der Alster 3", "An dem Bach 3", "In der Au 5", "Am\u00a0Markt 2", "Im\nGrund 2", "AM Hang 4", "Zur Linde 8", "Zum\tTor 8"],
    ["Calle Mayor 3", "CALLE Mayor 3", "CalLe Mayor 3", "Calle\u00a0de la Luna 3", "c/Mayor, 3", "Avda. del Sol 9", "avenida\nNorte 9", "PlazaMayor 4", "Paseo Bajo 1", "camino Real 2", "Ronda Sur 5", "Travesía Alta 6", "TRAVESÍA ALTA 6", "Carrer Nou 7"],
]


def test_whatever_a_form_matches_has_its_sign():
    assert len(FORMS) == len(pii_spans.ADDRESSES)
    for (sign, form), texts in zip(pii_spans.ADDRESSES, FORMS):
        for text in texts:
            assert form.search(text) and sign(text), text
            assert any(kind == "ADDRESS" for kind, *_ in pii_spans.spans(f"({text})")), text
    for at in ("@", " @ ", " at ", " AT ", " arroba ", " chez ", " Chez ", "(at)", " [ät] ", "<arroba>"):
        for dot in (".", " dot ", " [dot] ", "(dot)", " punkt ", " point ", " punto "):
            text = f"selma.x{at}post{dot}fr"
            assert pii_spans.EMAIL.search(text) and pii_spans.EMAIL_HINT.search(text), text
            assert [kind for kind, *_ in pii_spans.spans(text)] == ["EMAIL"], text


def test_label_model_finds_the_reliable_labelers():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.4
    votes = np.zeros((4000, 6), int)
    for j, right in enumerate((0.95, 0.9, 0.6, 0.5)):
        said = rng.random(4000) < 0.8
        votes[:, j] = np.where(said, np.where((rng.random(4000) < right) == y, 1, -1), 0)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = pii_spans.estimate(patterns, counts.astype(float))[inverse.ravel()]
    majority = votes.sum(1) > 0
    assert ((post > 0.5) == y).mean() > max(0.9, (majority == y).mean())


PROSE = "The committee met on Monday and agreed that the pump should be replaced. It was noted that the valve is open."
KINDS = {
    "prose": [PROSE, "so we went to the house and then it was that they said it is not for us to be in there with the others " * 3, PROSE + " https://example.org/" + "a" * 2000],
    "list": ["- pump\n- valve (3)\n- meter, done\n- shelf x 4", "1.1 Pump ........ 12\n1.2 Valve ....... 15\n2.1 Meter .... 18", "Pump; Valve of the meter; Shelf; Boiler x 3; Gauge"],
    "table": ["| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | n/a |", "pump\t3.5\t17\nvalve\t12\t-\nmeter\t1\t2", "Pump;Valve;Meter\nA1;22;3.5\nB2;1;ok", "pump 12.5 33 no\nvalve 1 2 3\nmeter 8 9 yes"],
    "junk": ["0x12ab 9f8e7d6c ab12cd34\n0x99aa 11bb22cc 33dd44ee", "~^<>=*_+ #~~ ^^= <<>> ~*", "bfw kjwnlp lxzpgc xkrt qpkdqhbj", "#####\n#####\n#####"],
}


def labelled_pages(n=3):
    """The pages of KINDS, each with ``n`` labelled copies, and labels that call some of them otherwise."""
    known = [(1000 + 100 * c + i, t, k) for c in range(n) for i, (k, t) in enumerate((k, t) for k, ts in KINDS.items() for t in ts)]
    return known, [(i, k.upper() if i % 3 else f" {k} ") for i, _, k in known] + [(1000, "junk"), (None, "list"), (1, None)]


@pytest.mark.parametrize("copies", [1, 3])
def test_rules_tell_the_kinds(spark, copies):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in KINDS.items() for t in ts)] + [(90, None, None), (91, "", None), (92, " \n", None)]
    known, labels = labelled_pages(copies)
    df = spark.createDataFrame(rows + known, "rec_id long, page_content string, want string").withColumns({"words": F.lit("clash"), "metadata": F.create_map(F.lit("page"), F.lit("3"), F.lit("stat_words"), F.lit("old"))})
    out, rules = quality_rules.classify(df, "rec_id", "page_content", spark.createDataFrame(labels, "item_id long, label string"), COMMON)
    assert rules and all(r.label == "other" for r in rules)
    for r in out.collect():
        assert r["kind"] == r["want"] and r["words"] == "clash", r["page_content"]
    for r in quality_rules.as_metadata(out).filter("rec_id < 1000").collect():
        assert r["metadata"]["page"] == "3" and r["metadata"]["stat_kind"] == r["want"] and r["metadata"]["stat_words"] != "old" and "stat_words" not in r.asDict()
    none, rules = quality_rules.classify(df.filter("rec_id < 90"), "rec_id", "page_content", spark.createDataFrame([], "item_id long, label string"), COMMON)
    assert not rules and {r["kind"] for r in none.collect()} == {"prose"}
    assert quality_rules.classify(df.limit(0), "rec_id", "page_content", spark.createDataFrame(labels, "item_id long, label string"), COMMON)[0].count() == 0


def test_rules_use_other_statistics_where_these_tell_more():
    rng = np.random.default_rng(3)
    y = np.where(rng.random(600) < 0.3, "other", "prose")
    x = {k: rng.random(600) for k in quality_rules.FEATURES}
    x["mean_word_length"] = np.where(y == "other", 9 + rng.random(600), 4 + rng.random(600))
    x["common_words"] = np.where(y == "other", 0.1, 0.4) + 0.05 * rng.random(600)
    rules = quality_rules.induce(x, y.astype(str), "prose")
    assert {c[0] for r in rules for c in r.conditions} <= {"mean_word_length", "common_words"}


def test_only_a_single_long_string_is_shortened(spark):
    blobs = ["".join(random.Random(k).choices("abcdefXYZ0123456789", k=4000)) for k in range(2)]
    rows = [(1, "\n".join([PROSE] * 3 + blobs)), (2, "\n".join([PROSE] * 3 + blobs[:1])), (3, PROSE + " " + "#/" * 900), (4, "see " + "z" * 80 + " and " + "https://a.example/" + "y" * 200)]
    known, labels = labelled_pages()
    df = spark.createDataFrame(rows + [k[:2] for k in known], "rec_id long, page_content string")
    out = quality_rules.classify(df, "rec_id", "page_content", spark.createDataFrame(labels, "item_id long, label string"), COMMON)[0]
    got = {r["rec_id"]: r for r in out.collect()}
    assert [got[k]["kind"] for k in (1, 2)] == ["junk", "prose"]
    for k, text in rows:
        assert got[k]["stat_chars"] == len("".join(text.split())) and 0 <= got[k]["stat_symbol_ratio"] <= 1 and got[k]["stat_digit_ratio"] <= 1
        assert abs(sum(got[k][f"stat_{n}_share"] for n in ("junk", "table", "list", "prose")) - 1) < 1e-9


def test_rules_are_learned_from_noisy_labels():
    rng = np.random.default_rng(2)
    x = {"list_share": rng.random(900), "table_share": rng.random(900), "words": rng.random(900)}
    y = np.where(x["list_share"] > 0.62, "list", np.where(x["table_share"] > 0.71, "table", "prose")).astype(str)
    noisy = y.copy()
    flip = rng.random(900) < 0.05
    noisy[flip] = rng.choice(["list", "table", "prose"], flip.sum())
    rules = quality_rules.induce({k: v[:600] for k, v in x.items()}, noisy[:600], "prose")
    out = np.full(300, "prose", dtype=object)
    for rule in reversed(rules):
        out[rule.covers({k: v[600:] for k, v in x.items()})] = rule.label
    assert (out == y[600:]).mean() > 0.93
    assert quality_rules.case_expression(rules, "prose", ("list",)).startswith("CASE WHEN `") and quality_rules.case_expression([], "prose", ("list",)) == "'prose'"


def test_votes_of_reviewers(spark):
    rows = [(1, " LIST "), (1, "list"), (1, "table"), (2, "list"), (2, "table"), (3, None), (4, "odd"), (5, "junk")]
    got = quality_rules.labelled(spark.createDataFrame(rows, "item_id long, label string"), "item_id", "label", ["list", "table", "junk"], 10)
    assert {tuple(r) for r in got.collect()} == {(1, "list"), (5, "junk")}


def scans():
    """Scanned pages with known faults, and clean pages that know the words."""
    clean = [(i, "The independent committee will inspect the long-term maintenance contract. Every employee should read the handbook and the contract.", None) for i in range(100, 112)]
    pages, faults = [], set()
    for i in range(6):
        lines = [("OPERATIONS HANDBOOK" if i % 2 else "Operations Handbook    %d" % i), "The indepen-", "dent committee will inspect the long-", "term maintenance c0ntract every day,", "while fhe employee should read it and", "the handbook", "", "2.1 Annual claim", "Every ernployee should read the con-", "tract and the handbook.", f"Page {i} of 9"]
        pages.append((i, "\n".join(lines), "eng"))
        faults |= {(i, 0, "header"), (i, 1, "hyphen"), (i, 3, "char"), (i, 4, "char"), (i, 8, "char"), (i, 8, "hyphen"), (i, 10, "pageno")}
    return clean + pages + [(None, pages[0][1], "eng"), (200, None, "eng"), (201, "", "eng")], faults


def test_faults_of_scanned_pages(spark):
    rows, want = scans()
    df = spark.createDataFrame(rows, "rec_id long, page_content string, lang string")
    got = [(r["rec_id"], r["line_no"], r["kind"]) for r in ocr_repair.faults(df, "rec_id", "page_content", F.col("lang").isNotNull()).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert set((r["rec_id"], r["line_no"], r["kind"]) for r in ocr_repair.faults(df, "rec_id", "page_content").collect()) == want  # told by the wrapped lines alone
    text = {r["rec_id"]: r["text"] for r in ocr_repair.repaired(df, "rec_id", "page_content", F.col("lang").isNotNull()).collect()}
    assert text[1] == "The independent committee will inspect the long-term maintenance contract every day, while the employee should read it and the handbook\n\n2.1 Annual claim\n\nEvery employee should read the contract and the handbook."
    assert ocr_repair.faults(df.limit(0), "rec_id", "page_content").count() == 0


def test_titles_in_the_middle_of_pages_are_no_headers(spark):
    body = "the pump was moved to the basement and\nevery employee should read the handbook\nwhile the committee is in the office"
    rows = [(i, f"Operations Handbook\n{body}\nSafety notes\n{body} {i}\nPage {i}", "eng") for i in range(30)]
    df = spark.createDataFrame(rows, "rec_id long, page_content string, lang string")
    got = {tuple(r) for r in ocr_repair.faults(df, "rec_id", "page_content", F.col("lang").isNotNull()).collect()}
    assert got == {(i, 0, "header") for i in range(30)} | {(i, 8, "pageno") for i in range(30)}


def test_misread_forms_that_are_words_are_told_by_their_neighbours(spark):
    clean = [(i, "The committee will read the handbook and the contract. A visit to the arid region is due.", None) for i in range(100, 170)]
    scan = "The committee will read the handbook arid\nthe contract while a visit to the arid region, arid\nthe handbook arid the contract, is due"
    df = spark.createDataFrame([*clean, (1, scan, "eng")], "rec_id long, page_content string, lang string")
    got = {tuple(r) for r in ocr_repair.faults(df, "rec_id", "page_content", F.col("lang").isNotNull()).collect()}
    assert got == {(1, 0, "char"), (1, 2, "char")}
    text = ocr_repair.repaired(df, "rec_id", "page_content", F.col("lang").isNotNull()).collect()[0]["text"]
    assert text == "The committee will read the handbook and the contract while a visit to the arid region, arid the handbook and the contract, is due"


PILED = [
    "#pump #valve #meter #shelf #pump #boiler #gauge #pump",
    "pump cheap, valve cheap, pump buy, pump price, valve buy, pump cheap, meter buy, pump cheap",
    "\n".join(f"pump {c} cheap" for c in ("Norwick", "Wexbury", "Altfurt", "Norwick", "Valcourt", "Millport", "Altfurt")),
    "\n".join(f'<a href="http://a{i}.example/x">pump</a>' for i in range(8)),
    "\n".join(f"[pump {i}](https://b{i}.example)" for i in range(8)),
    "https://a.example | Pump | https://b.example | www.c.example | Valve | https://d.example/x",
    "Filed under: pump, valve, the meter, cheap, valve, pump",
    "pump red XL SKU9198; valve blue M SKU8809; meter new SKU7958; shelf XL SKU8102",
    " ".join(["cheap pump buy pump best pump order now pump"] * 6),
]
FINE = [
    PROSE * 3,
    "Contents\n" + "\n".join(f"- part number {i} of the pump" for i in range(9)),
    "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {i * 3}.5 |" for i in range(9)),
    "pump\t1\t2\nvalve\t3\t4",
    "\n".join(f"Term{i}: The pump is a part of the machine that moves water." for i in range(5)),
    "def load(path):\n    rows = []\n    for line in open(path):\n        rows.append(line)\n    return rows",
    PROSE * 4 + "\n\nReferences\n[1] The pump, https://a.example/x\n[2] The valve, www.b.example",
    '{"pump": "The valve is open and the pump is closed.", "meter": "It was read on Monday by the committee."}',
    "Contents\nTechnical ledger; Workflow x 1; Modern estimate; Quarry workshop; First directive; Index of the meter; Urgent procedure; Deadline x 12",
]


def test_stuffed_pages(spark):
    rows = [(i, t) for i, t in enumerate(PILED + FINE)] + [(None, PILED[0]), (90, None), (91, ""), (92, "\n \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash"))
    got = {r["doc_id"] for r in stuffing.stuffed_pages(df, "doc_id", "text", COMMON).collect()}
    assert got == set(range(len(PILED)))
    half = PROSE + "\n" + PILED[0] + " " + PILED[0] * 2
    assert stuffing.stuffed_pages(spark.createDataFrame([(1, half), (2, PROSE * 5 + "\n" + PILED[0])], "doc_id long, text string"), "doc_id", "text", COMMON).collect()[0]["doc_id"] == 1
    assert stuffing.stuffed_pages(df.limit(0), "doc_id", "text", COMMON).count() == 0


def test_piled_lines_of_many_shapes(spark):
    link = "https://a.example/" + "x" * 60
    lines = [" ".join([link, *[w] * n]) + s * k for w in ("pump", "Pump") for n in (0, 1, 3, 7) for s, k in (("", 0), (" |", 1), (" |", 3))]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines) + "\n" + PROSE * 40)], "doc_id long, text string")
    [found] = stuffing.stuffed_pages(df, "doc_id", "text", COMMON).collect()
    assert found["doc_id"] == 1 and found["shapes"] > 15


def test_repeated_phrases_are_counted_exactly():
    names = ["".join(p) for p in itertools.product("bdfgk", "aeiou", "lmnrst", "aeiou")]
    for n in range(50, 400, 25):
        [(shape, g)] = stuffing.shapes("\n".join(f"{names[k % n]} pump" for k in range(2 * n)), frozenset(COMMON)).items()
        assert shape == ("phrase",) and (g.lines, len(g.starts), len(g.heads)) == (2 * n, n, n) and stuffing.piled(shape, g)
        g.starts.add("one more")
        assert not stuffing.piled(shape, g)


def test_the_shape_and_what_its_lines_repeat_decide():
    row = "pump valve, meter shelf, boiler gauge, lamp cable, desk chair, floor tile, roof beam"
    judged = lambda text: [(s[0], stuffing.piled(s, g)) for s, g in stuffing.shapes(text, frozenset(COMMON)).items()]
    assert judged(row) == [("", False)] and judged("\n".join([row] * 3)) == [("", True)]  # one group, the same units again
    assert judged("\n".join("- " + row for _ in range(3))) == [("bullet", False)]
    assert judged(PROSE) == [("", False)] and judged(PROSE + "\n" + row + "\n" + row)[1:] == [("", True)]


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_every_registered_query_runs(spark):
    from lectern.llm import queries

    columns = {
        "p1_found": ["row_id"], "p2_found": ["rec_id", "boundary"], "p3_found": ["emb_a", "emb_b"], "p4_found": ["tab", "item_id", "kind", "start_pos"], "p5_found": ["rec_id", "kind"],
        "p6_found": ["rec_id", "line_no", "kind"], "p7_found": ["row_a", "row_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
    }
    for name, f in queries.queries().items():
        df = f(spark, DATA)
        assert df.count() >= 0 and (name not in columns or df.columns == columns[name]), name
