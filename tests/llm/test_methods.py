"""The operators against brute force, exact round trips and known cases."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docweft.llm import consensus, grid_union, leakage, mojibake, names, packing, segments, truncation
from docweft.llm.sentences import sentence_units


def units(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    rows = df.select(F.explode(sentence_units(F.col("text"))).alias("u")).select("u.*").collect()
    assert all(text[r.start_char : r.end_char] == r.text for r in rows)
    return [r.text for r in rows]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Mr. J. S. Smith paid $3.50 to Acme, Inc. on Jan. 3, 2020. The clerk left at 5 p.m. Nobody spoke.", ["Mr. J. S. Smith paid $3.50 to Acme, Inc. on Jan. 3, 2020.", "The clerk left at 5 p.m.", "Nobody spoke."]),
        ("He asked, “Who? Was it you?” and left. “You are fired!” Jane Roe shouted. It was over.", ["He asked, “Who? Was it you?” and left.", "“You are fired!” Jane Roe shouted.", "It was over."]),
        ("See www.example.com/a.html now. Done.", ["See www.example.com/a.html now.", "Done."]),
        ("法院认为，证据不足。这一决定毫无根据！他说：“我不同意。请重新计算！”随后离开了。", ["法院认为，证据不足。", "这一决定毫无根据！", "他说：“我不同意。请重新计算！”随后离开了。"]),
        ("Γιατί δεν απάντησε; Η εταιρεία έφυγε.", ["Γιατί δεν απάντησε;", "Η εταιρεία έφυγε."]),
        ("พยานไม่มาศาล นายจ้างเลิกจ้าง", ["พยานไม่มาศาล", "นายจ้างเลิกจ้าง"]),
        ("Der 2. Zeuge kam am 3. 7. 2024 z. B. spät. Er ging.", ["Der 2. Zeuge kam am 3. 7. 2024 z. B. spät.", "Er ging."]),
        ("PARTIES\n\nThe plaintiff\nsued; the court (see Ex. 3. No more) agreed.", ["PARTIES", "The plaintiff\nsued; the court (see Ex. 3. No more) agreed."]),
        ("वादी आया। गवाह क्यों नहीं आया?", ["वादी आया।", "गवाह क्यों नहीं आया?"]),
        ("", []),
        (" \n\n ", []),
    ],
)
def test_sentences(spark, text, expected):
    assert units(spark, text) == expected


def test_sentences_cover_everything(spark):
    rng = random.Random(1)
    for _ in range(20):
        text = "".join(rng.choice("ab Z.!?“”() \n1。Ж") for _ in range(200))
        got = units(spark, text.replace("", "x"))
        assert "".join("".join(got).split()) == "".join(text.replace("", "x").split())


def test_offsets_of_many_units(spark):
    text = " \n".join(f"The court of Town{k} heard Mr. Smith." for k in range(1000)) + "\n\n \nLast"
    got = units(spark, text)
    assert len(got) == 1001 and got[700] == "The court of Town700 heard Mr. Smith." and got[-1] == "Last"


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
@pytest.mark.parametrize("cell", [20, 10_000])
def test_components(spark, shape, cell):
    rng = random.Random(7)
    name = lambda k: f"v{k:04d}"
    edges = {"random": [(name(rng.randrange(300)), name(rng.randrange(300))) for _ in range(220)], "chain": [(name(k), name(k + 1)) for k in range(250)], "star": [(name(0), name(k)) for k in range(1, 250)] + [(name(400), name(401))]}[shape]
    edges += edges[:9] + [(None, "v1"), ("v2", "v2")]
    got = grid_union.components(spark.createDataFrame(edges, "a string, b string"), "a", "b", cell).collect()
    assert {(r.member, r.group_id) for r in got} == brute_components(edges)
    assert len(got) == len({r.member for r in got})


def test_grid_always_has_several_cells(spark):
    # At the default size as well, and an overfull cell is split.
    edges = spark.createDataFrame([("hub", f"v{k:03d}") for k in range(200)], "a string, b string")
    assert grid_union.cells(edges, 0).select("r", "c").distinct().count() > 1
    per_cell = grid_union.cells(edges, 0, 10).groupBy("r", "c", "part").count().agg(F.max("count")).first()[0]
    assert per_cell < 30


def test_ids_that_differ_in_case_are_all_linked(spark):
    events = spark.createDataFrame([("e1",), ("E1",), ("E2",), ("E3",), ("e3 ",), ("E4",), (None,)], "event_id string")
    matches = spark.createDataFrame([("e1", " E2", True), ("E3", "E3", True), ("E4", "E4", True), ("E4", "E9", True), ("E4", "E2", None)], "event_a string, event_b string, same_event boolean")
    got = {tuple(r) for r in grid_union.event_groups(matches, events).collect()}
    assert got == {("e1", "E1"), ("E1", "E1"), ("E2", "E1"), ("E3", "E3"), ("e3 ", "E3")}


def test_consensus_beats_majority(spark):
    rng = np.random.default_rng(3)
    accuracy = np.concatenate([np.full(10, 0.9), np.full(5, 0.55), np.full(4, 0.15)])
    truth = rng.random(1500) < 0.5
    rows = []
    for i, y in enumerate(truth):
        for p in rng.choice(len(accuracy), 5, replace=False):
            right = rng.random() < accuracy[p]
            rows.append((f"{i}-{p}", "d", i, "Fact" if y == right else "non-fact ", f"u{p}", "2024-01-01", "2024-01-02"))
    a = spark.createDataFrame(rows, "id string, dataset_id string, item_index int, label string, user_id string, created_at string, updated_at string")
    got = {r.item_index: r.label == "fact" for r in consensus.consensus(a).collect()}
    right = np.mean([got[i] == y for i, y in enumerate(truth)])
    majority = a.withColumn("v", consensus.vote(F.col("label"))).groupBy("item_index").agg(F.sum("v").alias("s")).toPandas().set_index("item_index")["s"]
    assert right > 0.93 and right > np.mean([(majority[i] >= 0) == y for i, y in enumerate(truth)]) + 0.1
    people = consensus.reliabilities(consensus.latest_votes(a)).toPandas().set_index("user_id")["accuracy"]
    assert np.mean([abs(people[f"u{k}"] - x) for k, x in enumerate(accuracy)]) < 0.06


def test_agreement_and_triplets_against_brute_force(spark, monkeypatch):
    # Small cells: items with many votes are counted in parts.
    monkeypatch.setattr(consensus, "CELL_VOTES", 4)
    rng = random.Random(5)
    votes = [("d", i, f"u{p}", rng.choice((1, -1))) for i in range(30) for p in rng.sample(range(14), rng.randrange(0, 14))]
    votes += [("d", 99, None, 1), ("d", 98, "lonely", 1)]
    df = spark.createDataFrame(votes, "dataset_id string, item_index int, user_id string, vote int")
    want = {}
    for d, i, u, x in votes:
        for e, k, w, y in votes:
            if u and w and (d, i) == (e, k) and u < w:
                n, s = want.get((u, w), (0, 0))
                want[u, w] = (n + 1, s + x * y)
    pairs = consensus.agreement(df)
    assert {(r.i, r.j): (r.n, round(r.c * r.n)) for r in pairs.collect()} == want
    met = {frozenset(k) for k in want}
    people = sorted({u for k in want for u in k})
    three = {frozenset((a, b, c)) for a in people for b in people for c in people if len({a, b, c}) == 3 and {frozenset((a, b)), frozenset((a, c)), frozenset((b, c))} <= met}
    got = [frozenset((r.a, r.b, r.e)) for r in consensus.triplets(pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == three


def test_latest_label_counts(spark):
    rows = [("1", "d", 0, "fact", "u", "1", "1"), ("2", "d", 0, "NON-FACT", "u", "1", "2"), ("3", "d", 1, "skip", "u", "1", "1"), ("4", "d", 2, "fact", None, "1", "1")]
    a = spark.createDataFrame(rows, "id string, dataset_id string, item_index int, label string, user_id string, created_at string, updated_at string")
    assert {(r.item_index, r.label) for r in consensus.consensus(a).collect() if r.item_index != 2} == {(0, "non-fact")}


@pytest.mark.parametrize("part_items", [50, 10_000])
def test_packing(spark, part_items):
    rng = random.Random(5)
    sizes = [(k, rng.choice([1, 90, 100, 101, 350, rng.randrange(1, 100)])) for k in range(400)] + [(999, None), (1000, 0)]
    p = packing.pack(spark.createDataFrame(sizes, "id long, s long"), "id", F.col("s"), 100, part_items).toPandas()
    total = p.groupby("item")["size"].sum()
    assert dict(total) == {k: s for k, s in sizes if s is not None}
    bins = p.groupby(["round", "part", "bin"])["size"].sum()
    assert bins.max() <= 100 and len(bins) < p["size"].sum() / 100 * 1.1 + 2
    assert set(p[p.piece > 0]["item"]) == {k for k, s in sizes if s and s > 100}
    assert (p.groupby(["round", "part"])["bin"].nunique() >= 0).all()


def test_packing_goes_on_while_it_saves(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(k, rng.randrange(20, 70)) for k in range(600)], "id long, s long")
    p = packing.pack(rows, "id", F.col("s"), 100, 8)
    one = packing.pack(rows, "id", F.col("s"), 100, 10_000)
    assert p.agg(F.max("round")).first()[0] >= 1 and one.select("part").distinct().count() >= 2
    s = packing.summary(p, 100).first()
    assert s.items == 600 and s.bound <= s.containers <= s.bound * 1.25


def test_too_many_item_words_raise(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_ITEM_WORDS", 3)
    d = spark.createDataFrame([(1, "a")], "doc long, text string")
    q = spark.createDataFrame([(k, "" if k < 5 else "word") for k in range(9)], "idx long, a string")
    with pytest.raises(ValueError):
        leakage.leaks(d, q, "doc", "text", "idx", [F.col("a")])
    assert leakage.leaks(d, q.filter("idx < 6"), "doc", "text", "idx", [F.col("a")]).count() == 0


def test_lower_bound_holds():
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = rng.integers(1, 100, 30)
        assert packing.lower_bound(s, 100) <= packing.best_fit_decreasing(s, 100)[1]
    assert packing.lower_bound(np.array([51] * 9), 100) == 9


def test_truncation(spark):
    whole = [f"Case {k} was heard. The court in Town{k} denied the motion of the party {k * 7}.\n\nBY THE COURT" for k in range(40)]
    cut_ = whole[3][:50]
    texts = [*whole, cut_, "The plaintiff said that the [text truncated]", "It ended well. The clerk then wal", whole[5], None, "", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    bad = {r.tail: r for r in truncation.truncated_texts(df).collect()}
    assert set(bad) == {cut_.rstrip(), texts[41], texts[42]}
    assert bad[cut_.rstrip()].copy and bad[texts[41]].mark and bad[texts[42]].open


def test_prefixes_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    got = {r.digest for r in truncation.prefixes(df).collect()}
    import hashlib

    assert got == {hashlib.md5(t.encode()).hexdigest() for t in texts if t and any(o != t and o.startswith(t) for o in texts)}


def test_segments(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(60)]
    texts = {str(k): " ".join(" ".join(rng.choices(words, k=8)).capitalize() + "." for _ in range(n)) for k, n in enumerate((1, 40, 200))}
    texts["blank-less"] = "x" * 2500
    texts["long sentence"] = " ".join(rng.choices(words, k=400))
    df = spark.createDataFrame([(k, t) for k, t in texts.items()] + [("none", None)], "id string, t string")
    p = segments.split_oversized(df, "id", "t", 600, 80).toPandas()
    assert set(p["id"]) == {k for k, t in texts.items() if len(t) > 600}
    for k, g in p.groupby("id"):
        g, covered = g.sort_values("piece"), 0
        for r in g.itertuples():
            assert texts[k][r.start_char : r.end_char] == r.text and 0 < len(r.text) <= 600 and 0 <= r.overlap <= 80
            assert texts[k][covered : r.start_char].strip() == "" and r.end_char > covered
            covered = r.end_char
        assert texts[k][covered:].strip() == ""


def test_valley_between_topics():
    a, b = ["The cat chased mice around."] * 6, ["Tax rates were raised again."] * 6
    assert int(np.argmax(segments.valley_depths(a + b))) == 5


def test_fm_index():
    rng = np.random.default_rng(8)
    s = rng.integers(0, 5, 400)
    index = leakage.FMIndex(s)
    for n in (1, 2, 3):
        for _ in range(20):
            g = rng.integers(1, 5, n)
            lo, hi = index.search(g[None, :], np.array([n]))
            at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert at == [k for k in range(len(s) - n + 1) if (s[k : k + n] == g).all()]


def test_leaks(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    stock = text(16)
    items = [(k, f"{text(40)} {stock}", text(20), text(40)) for k in range(12)]
    leaked = items[3][1].split()[5:30]
    altered = leaked[:]
    altered[8] = "indeed"
    altered[16:16] = ["simply"]
    docs = [(1, text(100)), (2, f"{text(20)} {' '.join(leaked).upper()} {text(9)}"), (3, f"{text(9)}, {' '.join(altered)}. {text(9)}"), (4, f"{text(9)} {stock} {text(9)}"), (5, None), (6, ""), (7, " ".join(items[7][3].split()[:14]))]
    docs.append((8, " ".join(leaked).replace("o", "0").replace("l", "1")))
    d, q = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "idx long, a string, b string, c string")
    found = leakage.leaks(d, q, "doc", "text", "idx", [F.col("a"), F.col("b"), F.col("c")])
    assert {(r.doc, r.idx) for r in found.collect()} == {(2, 3), (3, 3), (7, 7), (8, 3)}
    assert leakage.removal_spans(found, "doc", "idx").count() == 4


def test_every_run_of_twelve_counts(spark):
    # Set phrases in equal parts: a run of 12 of them carries few bits, but is nobody else's.
    rng = random.Random(4)
    nouns = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(6)]
    phrase = lambda: f"a {rng.choice(nouns)} held the {rng.choice(nouns)} by"
    items = [(k, " ".join(phrase() for _ in range(8))) for k in range(30)]
    other = lambda n: " ".join(rng.choices("qrtuvwx", k=n))
    free = ["".join(rng.choices("ijklmnop", k=7)) for _ in range(60)]
    items.append((100, " ".join(free)))
    plain = items[5][1].split()[6:18]
    altered = free[:14]
    altered[7] = "indeed"
    docs = [(1, f"{other(9)} {' '.join(plain)} {other(9)}"), (2, f"{other(9)} {' '.join(altered)} {other(9)}"), (3, f"{other(9)} {' '.join(free[:11])} {other(9)}")]
    d, q = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "idx long, a string")
    found = {(r.doc, r.idx) for r in leakage.leaks(d, q, "doc", "text", "idx", [F.col("a")]).collect()}
    assert (1, 5) in found
    assert {x for x in found if x[0] > 1} == {(2, 100)}


def test_all_passages_of_an_item_are_removed(spark):
    rng = random.Random(4)
    other = lambda n: " ".join(rng.choices("qrtuvwx", k=n))
    t = ["".join(rng.choices("ijklmnop", k=7)) for _ in range(60)]
    docs = [(1, f"{other(5)} {' '.join(t[:20])} {other(9)} {' '.join(t[30:50])} {other(9)} {' '.join(t[:20])}"), (2, f"{other(5)} {' '.join(t[5:35])} {other(4)}")]
    d, q = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame([(7, " ".join(t[:28]), " ".join(t[20:]))], "idx long, a string, b string")
    found = leakage.leaks(d, q, "doc", "text", "idx", [F.col("a"), F.col("b")])
    spans = {(r.doc, r.first_word, r.end_word, tuple(r["items"])) for r in leakage.removal_spans(found, "doc", "idx").collect()}
    assert spans == {(1, 5, 25, (7,)), (1, 34, 54, (7,)), (1, 63, 83, (7,)), (2, 5, 35, (7,))}


CLEAN = ["The résumé of José was naïve, “quite” so.", "Le requérant a été licencié après l’été à Orléans, déjà là.", "Суд установил, что истец прав.", "Die Kündigung wäre für Gehälter gültig gewesen, § 5."]


@pytest.mark.parametrize("written, read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "mac_roman")])
def test_garbling_round_trip(spark, written, read):
    texts = CLEAN * 60
    bad = [mojibake.garble(t, written, read) for t in CLEAN[:2] + CLEAN[3:]] * 2
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(bad)] + [(5000, None), (5001, "plain ascii?")]
    got = mojibake.repair(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dict(enumerate((CLEAN[:2] + CLEAN[3:]) * 2, 1000))
    assert {r.doc_id for r in got} == set(want)
    assert np.mean([r.restored == want[r.doc_id] for r in got]) >= 0.5


@pytest.mark.parametrize("share", [1, 2])
def test_common_garbling_is_found(spark, share):
    # A third, then half of all rows are UTF-8 read as another encoding; the garbled forms are as usual as the clean ones.
    clean = [CLEAN[0], CLEAN[1], CLEAN[3]]
    bad = [mojibake.garble(t, "utf-8", "cp1252") for t in clean] * (20 * share)
    rows = [(k, t) for k, t in enumerate(clean * 40)] + [(1000 + k, t) for k, t in enumerate(bad)]
    got = mojibake.repair(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.restored for r in got} == {1000 + k: clean[k % 3] for k in range(len(bad))}


def test_alignment():
    assert mojibake.windows("rÃ©sumÃ©,", 4) == [("^r\x01sum", "Ã©"), ("sum\x01,$", "Ã©")]
    assert mojibake.windows("0å¹´0é", 4) == [("^0\x010", "å¹´")]
    assert ("utf-8", "cp1252") in [mojibake.PAIRS[k] for k in mojibake.explains("Ã©", "é")]
    assert mojibake.pattern("Ответили") == mojibake.pattern("ЋвўҐвЁ«Ё") and mojibake.pattern("été") is None


def test_an_encoding_that_no_list_has_is_learned(spark):
    # Signs instead of accents, by no known encoding: the aligned twins alone teach them, also for words that have no twin.
    table = str.maketrans({"é": "␣", "è": "␤", "à": "␥", "ç": "␦"})
    words = "résumé clérical pénalité décision générosité mère père critère règlement voilà déjà reçu leçon façade répété célèbre".split()
    # Damage is rare: one text of a thousand teaches, another one is restored with it.
    rows = [(k, " ".join(words)) for k in range(1200)]
    rows += [(5000, " ".join(words[:9]).translate(table)), (6000, "un inédité très réglé".translate(table))]
    got = {r.doc_id: r.restored for r in mojibake.repair(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5000: " ".join(words[:9]), 6000: "un inédité très réglé"}


def test_lost_characters_are_found(spark):
    rows = [(k, "The résumé of José was naïve.") for k in range(40)] + [(99, "The r�sum� of Jos� was long.")]
    got = mojibake.repair(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.restored) for r in got] == [(99, "The résumé of José was long.")]


def test_names(spark):
    same = [["Charles W. Bolfilder", "Bolfilder, Charles W.", "CHARLES BOLFILDER", "Chuck Bolfilder", "C.W. Bolfilder", "Charles Bolfiledr", "Mr. Bolfilder"], ["Anna Krentos Jr.", "Krentos, Anna Jr."], ["Anna Krentos Sr.", "ANNA KRENTOS, SR."], ["Zolpin Workers Local 12", "Local 12, Zolpin Workers", "ZOLPIN WORKERS UNION LOCAL 12"], ["Zolpin Workers Local 21"], ["Vandrel Home Health Care, Inc.", "Vandrel HHC", "The Vandrel Home Health Care Incorporated"], ["Vandrel Medical Center"], ["Board of Education of Mirt County", "Mirt Cnty. Bd. of Educ."], ["Robert Bolfilder"]]
    nobody = ["Plaintiff", "the Company", "John Doe 1", "HR", "", None]
    rows = [(f"E{i}{k}", n, None) for i, g in enumerate(same[:1] + same[1:]) for k, n in enumerate(g)] + [(f"N{k}", n, "not json") for k, n in enumerate(nobody)]
    rows = [r for r in rows if r[1] not in ("Mr. Bolfilder",)]
    got = {(r.entity_id_a, r.entity_id_b) for r in names.entity_pairs(spark.createDataFrame(rows, "entity_id string, name string, aliases_json string")).collect()}
    of = {i: sorted(r[0] for r in rows if r[0].startswith(f"E{i}")) for i in range(len(same))}
    want = {(a, b) for g in of.values() for a in g for b in g if a < b}
    assert got == want


def test_aliases_bridge(spark):
    rows = [("1", "I. Varfonsur", json.dumps(["Ingrid Varfonsur"])), ("2", "Ingrid Varfonsur", "[]"), ("3", "Imani Varfonsur", "[]")]
    got = {(r.entity_id_a, r.entity_id_b) for r in names.entity_pairs(spark.createDataFrame(rows, "entity_id string, name string, aliases_json string")).collect()}
    assert got == {("1", "2")}


def linked(spark, *same):
    rows = [(f"E{i}{k}", n, None) for i, g in enumerate(same) for k, n in enumerate(g)]
    got = {(r.entity_id_a, r.entity_id_b) for r in names.entity_pairs(spark.createDataFrame(rows, "entity_id string, name string, aliases_json string")).collect()}
    ids = [[f"E{i}{k}" for k in range(len(g))] for i, g in enumerate(same)]
    return got, {(a, b) for g in ids for a in g for b in g if a < b}


def test_merged_profiles_enter_blocks_again(spark):
    # J. Zolpinder only meets the others by the initial that Robert Zolpinder got from J. Robert; the typos chain over two rounds.
    got, want = linked(spark, ["J. Robert Zolpinder", "Robert Zolpinder", "Robert Zolpnider", "J. Zolpinder"], ["Carla Smith", "Carla Smiht"], ["Dora Vandrelkonas", "Dora Vanbrelkomas"], ["Dora Vindrilkunes Jr."], ["Ann Lee", "ANN LEE"], ["Ann Lea"])
    assert got == want


def test_conflicting_names_are_not_chained(spark):
    # The one without a middle name goes to one of the two, who stay apart.
    rows = [("1", "John A. Bolfilder", None), ("2", "John B. Bolfilder", None), ("3", "John Bolfilder", None)]
    got = {(r.entity_id_a, r.entity_id_b) for r in names.entity_pairs(spark.createDataFrame(rows, "entity_id string, name string, aliases_json string")).collect()}
    assert len(got) == 1 and ("1", "2") not in got


def test_blocks_in_cells(spark, monkeypatch):
    rows = [names.pd.Series({"key": "k", "i": 0, "j": 0, "pid": f"p{k}", "kind": "P", "cores": ["bolfilder"], "firsts": [f"anna{'' if k < 3 else k}"], "middles": [], "suffixes": [], "n": 3 - k % 3}) for k in range(3)]
    assert {r[0]: r[2] for r in names._proposals(rows)} == {"p1": "p0", "p2": "p0"}


def test_pairs_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(names, "SLICE", 3)
    rows = [(f"{k:03d}", "Ann Zolpinder", "[]") for k in range(20)] + [(None, "Ann Zolpinder", None), ("x", None, None)]
    df = spark.createDataFrame(rows, "entity_id string, name string, aliases_json string")
    assert names.entity_pairs(df).count() == 190
    assert {(r.group_id, r["count"]) for r in names.entity_groups(df).groupBy("group_id").count().collect()} == {("000", 20)}


def test_distance():
    assert names.distance("abcd", "abdc", 2) == 1 and names.distance("abc", "xyz", 2) == 3 and names.distance("abc", "ab", 1) == 1
    assert pd.notna(names.parse("Smith, John", {}))


def test_rounds_of_names_are_few_jobs(spark):
    """Steps are joined to the groups at once, and a round without sure matches starts no job to accept them; each job leaves plans in the driver's memory."""
    rows = [("e1", "John Smith", None), ("e2", "J. Smith", None), ("e3", "Jon Smith", None), ("e4", "Acme Holdings LLC", None), ("e5", "Acme Holdings Inc.", None), ("e6", "Mary Jones", None)]
    sc = spark.sparkContext
    sc.setJobGroup("names", "")
    try:
        got = {(r.entity_id, r.group_id) for r in names.entity_groups(spark.createDataFrame(rows, "entity_id string, name string, aliases_json string")).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {("e1", "e1"), ("e2", "e2"), ("e3", "e3"), ("e4", "e4"), ("e5", "e4"), ("e6", "e6")}
    assert len(sc.statusTracker().getJobIdsForGroup("names")) < 78
