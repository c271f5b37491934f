"""Each operator against plain code on small documents: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import hashlib
import random

import pytest
from brute import base_spans, components, removed_bytes

from lonja.llm import (
    bpe,
    decontamination,
    jaccard_join,
    language,
    line_dedup,
    pii,
    queries,
    spotsigs,
    suffix_dedup,
    toxicity,
    unit_dedup,
)

COLUMNS = "doc_id long, text string"
ODD = [(None, "a row without an id"), (90, None), (91, ""), (92, "  \t\n"), (93, "é" * 40_000)]


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, edited copies, a shared passage and odd rows, with columns of clashing names."""
    draw = random.Random(4)
    words = [f"w{n}" for n in range(500)]
    base = draw.choices(words, k=80)
    passage = " ".join(draw.choices(words, k=55))
    texts = dict(ODD[1:])
    for n in range(12):
        edited = list(base)
        for _ in range(n % 5):
            edited[draw.randrange(80)] = draw.choice(words)
        texts[n] = " ".join(edited)
    for n in range(20, 30):
        own = " ".join(draw.choices(words, k=30))
        texts[n] = f"{own}\n{passage}\n{' '.join(draw.choices(words, k=10))}"
    texts[30] = texts[31] = texts[0]
    rows = [(i, t, 1, "x") for i, t in [*texts.items(), (None, "a row without an id")]]
    return spark.createDataFrame(rows, f"{COLUMNS}, n_dropped int, ids string"), texts


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_near_duplicates(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", 5)
    df, texts = docs
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert found.pop(None) == (1, None)
    assert found == components(texts)
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_pairs_are_judged_by_their_own_sizes(spark):
    rows = [(i, n, t, t, t) for t in range(6) for i, n in ((1, 80), (2, 100), (11, 80) if t < 3 else (12, 100))]
    both = [(5, 80, t, t, t) for t in range(6)] + [(6, 100, t, t, t) for t in range(7)] + [(5, 100, 6, 6, 6)]
    schema = "doc_id long, n long, token long, place long, known long"
    component = spark.createDataFrame([(1, 1), (11, 1), (2, 2), (12, 2)], "doc_id long, component long")
    for given, pair in ((rows, (1, 2)), (both, (5, 6))):
        found = jaccard_join._other_pairs(spark.createDataFrame(given, schema), component).collect()
        assert pair in [(r["a"], r["b"]) for r in found]


def test_near_duplicates_of_unequal_sizes(spark, monkeypatch):
    """Prefixes, extensions and edits around the threshold, with shingles of every frequency."""
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", 9)
    monkeypatch.setattr(jaccard_join, "IDS_TO_SEND", 0)  # ids and texts meet in a shuffle
    draw = random.Random(11)
    words = [f"w{n}" for n in range(3000)]
    texts = {}
    for group in range(12):
        base = draw.choices(words, k=draw.randrange(8, 120))
        for _ in range(14):
            own = list(base[: round(len(base) * draw.uniform(0.6, 1))])
            own += draw.choices(words, k=round(len(base) * draw.choice([0, 0, 0.1, 0.25])))
            if draw.random() < 0.3:
                own[draw.randrange(len(own))] = draw.choice(words)
            texts[len(texts)] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), COLUMNS)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert found == components(texts)


@pytest.mark.parametrize("own_words, linked", [(110, False), (30, True)])
def test_documents_of_one_template_do_not_meet_on_it(spark, monkeypatch, own_words, linked):
    """All share 400 words; with 110 words of their own none links, and no pair is formed."""
    draw = random.Random(3)
    template = draw.choices([f"t{n}" for n in range(900)], k=400)
    texts = {n: " ".join([*(f"own{n}x{k}" for k in range(own_words)), *template]) for n in range(150)}
    formed = []
    pairs = jaccard_join._other_pairs

    def counted(*given):
        found = pairs(*given)
        formed.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "_other_pairs", counted)
    df = spark.createDataFrame(list(texts.items()), COLUMNS)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(df).collect()}
    assert found == {n: 0 if linked else n for n in texts}
    assert formed == [0]


def test_suffix_array_dedup(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    df, texts = docs
    small = {i: t for i, t in texts.items() if i != 93} | {94: "ab" * 90, 95: "ba" * 90, 96: "q" * 49, 97: "q" * 200}
    rows = spark.createDataFrame([*small.items(), (None, "x" * 60)], COLUMNS)
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(rows).collect()}
    assert bytes(found.pop(None)["kept"]) == b"x" * 60
    plain = removed_bytes(small)
    for doc, row in found.items():
        removed = sum(b - a for a, b in zip(row["starts"], row["stops"]))
        assert (row["n_bytes"], removed, len(row["starts"]), bytes(row["kept"])) == plain[doc]
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_line_dedup(spark):
    shared = "This Line is long enough to be counted by all of them"
    rows = [(n, f"own {n}\n {shared.upper() if n % 2 else shared}\t\n{shared}\nshort") for n in range(6)]
    df = spark.createDataFrame([*rows, *ODD, (None, shared), (5, rows[5][1])], COLUMNS)
    clash = df.selectExpr("*", *(f"doc_id AS {c}" for c in ("row", "lines", "gone", "text_key", "_key", "_doc")))
    found = {}
    result = line_dedup.drop_common_lines(clash)
    assert result.columns == [*clash.columns, "n_lines", "n_dropped"]
    assert all(r["row"] == r["gone"] == r["doc_id"] for r in result.collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]
    for r in line_dedup.drop_common_lines(df).collect():
        found.setdefault(r["doc_id"], []).append((r["n_lines"], r["n_dropped"], r["text"]))
    for n in range(5):
        assert found[n] == [(4, 2, f"own {n}\nshort")]
    assert found[5] == [(4, 0, rows[5][1])] * 2
    assert found[90] == found[91] == [(1, 0, "")]
    assert (1, 0, shared) in found[None]
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0


def test_runs_know_earlier_lines(spark):
    runs = line_dedup.LineRuns(spark, 2)
    batches = [spark.createDataFrame([(n, n, 0), (n, 100, 0)], "doc_id long, low long, high long") for n in range(7)]
    for number, batch in enumerate(batches):
        assert {r["low"] for r in runs.unseen(batch).collect()} == ({0, 100} if number == 0 else {number})
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 2]
    whole = {r["low"]: (r["n_docs"], r["last_doc"]) for r in runs.merged().collect()}
    assert whole == {n: (1, n) for n in range(7)} | {100: (7, 6)}
    runs.close()


def test_batches_and_compactions_merge_buckets(spark, monkeypatch):
    """Neither the anti-join of a batch with the runs nor a compaction deals rows out anew."""
    monkeypatch.setattr(line_dedup, "FANOUT", 9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = line_dedup.LineRuns(spark, 3)
        for n in range(3):
            runs.add(spark.range(50).selectExpr(f"id + {n} AS doc_id", f"id * {n + 1} AS low", "id AS high"))
        first, second, third = (spark.table(t) for t in runs.levels[0])
        for plan in (runs.unseen(third), runs.merge(first, second), runs.merge(first, third, "left")):
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        assert first.join(second, ["low", "high"]).count() == 0
        runs.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unit_dedup(spark):
    unit = "This sentence is long enough to be found again anywhere."
    rows = [(2, f"Own. {unit} More."), (1, f"{unit}\nEnd."), (3, f"é {unit}"), *ODD, (None, unit)]
    found = {}
    for r in unit_dedup.remove_repeated_units(spark.createDataFrame(rows, COLUMNS)).collect():
        found.setdefault(r["doc_id"], []).append((r["kept"], [tuple(s) for s in r["removed"]]))
    assert found[1] == [(f"{unit}\nEnd.", [])]
    assert found[2] == [("Own. More.", [(5, 5 + len(unit) + 1)])]
    assert found[90] == [("", [])] and (unit, []) in found[None]
    assert unit_dedup.remove_repeated_units(empty(spark)).count() == 0


def test_repeated_passages_of_short_sentences(spark):
    passage = " ".join(f"One{n} two{n} three{n} four{n} five{n}." for n in range(12))
    lines = "\n\n".join(f"line {n} is short" for n in range(9))
    once = "It runs."
    rows = [
        (1, f"Ab. {passage} Cd."), (2, f"Ef.\n{passage}\nGh."), (3, f"{passage.upper()} Ij"), (4, f"Kl.\n{lines}"),
        (5, f"{lines}\nMn."), (6, " ".join([once] * 20)), (7, f"Short. Own{once}"), *ODD,
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    found = {r["doc_id"]: r for r in unit_dedup.remove_repeated_passages(df).collect()}
    for doc in (1, 4, 7):
        assert (found[doc]["kept"], found[doc]["removed"]) == (dict(rows)[doc], [])
    assert found[2]["kept"] == "Ef.\nGh." and [tuple(s) for s in found[2]["removed"]] == [(4, 5 + len(passage))]
    assert found[3]["kept"] == "Ij" and found[5]["kept"] == "Mn."
    assert found[6]["kept"].startswith(" ".join([once] * 6)) and len(found[6]["kept"]) < 9 * 9
    assert found[90]["kept"] == "" and unit_dedup.remove_repeated_passages(empty(spark)).count() == 0


def test_decontamination(spark, monkeypatch):
    item = " ".join(f"q{n}" for n in range(15))
    docs = [(1, f"a b {item.upper()} c"), (2, " ".join(["x"] * 400) + f" {item}"), (3, "two words"), (4, item[:20])]
    items = spark.createDataFrame([(7, item), (8, "Two, WORDS!"), (9, None), (10, "!!")], "item_id long, text string")
    for block in (1 << 21, 10):
        monkeypatch.setattr(decontamination, "PHRASE_BLOCK", block)
        rows = decontamination.contamination(spark.createDataFrame([*docs, *ODD], COLUMNS), items).collect()
        found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in rows}
        assert found[1] == (18, 15, [7], True)
        assert found[2] == (415, 15, [7], False)
        assert found[3] == (2, 2, [8], True)
        assert found[90] == found[91] == (0, 0, [], False)
    index = decontamination.build_index(spark.createDataFrame([(1, "a b c x d"), (2, "a b c d")], COLUMNS))
    phrase = decontamination.phrase_windows(spark.createDataFrame([(1, "a b c d")], "item_id long, text string"))
    assert [r["doc_id"] for r in decontamination.phrase_matches(index, phrase).collect()] == [2]
    near = decontamination.phrase_matches(index, phrase, slack=1).collect()
    assert sorted((r["doc_id"], r["exact"]) for r in near) == [(1, False), (2, True)]
    assert decontamination.contamination(empty(spark), items).count() == 0
    nothing = decontamination.contamination(spark.createDataFrame([*docs, *ODD], COLUMNS), items.where("item_id = 0"))
    assert {(r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in nothing.collect()} == {(0, (), False)}


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    draw = random.Random(1)
    parts = ["a", "'s", "'re", " ", "  ", "\n", "12", "!", "é", "日本", "<|endoftext|>", "<|endof", " the", "😀"]
    texts = {n: "".join(draw.choices(parts, k=draw.randrange(12))) for n in range(300)}
    texts |= {400: "".join(draw.choices("abcdefgh", k=3000)), 401: "x" * 5000, **dict(ODD[1:])}
    df = spark.createDataFrame([(i, t, "old") for i, t in texts.items()], f"{COLUMNS}, ids string")
    found = {r["doc_id"]: r for r in bpe.encoded_documents(df, path).collect()}
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[doc]["ids"] == ids
        assert found[doc]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encoded_documents(empty(spark), path).count() == 0


def test_personal_data(spark):
    draw = random.Random(6)
    parts = ["a", "b@", "x.com", ".", "-", "+", "1", "255", "256", "1.2.3.4", "4111111111111111", "+1 (017) 555-7713"]
    parts += ["4111 1111 1111 1111", " ", "é", "😀", "a@b.c", "+d@e.f", "\n", "(017) 555-7713", "call "]
    texts = {n: "".join(draw.choices(parts, k=draw.randrange(12))) for n in range(800)}
    texts |= {900: "a" * 20_000 + " " + "1." * 2000 + "a@" + "b." * 8000 + "c", **dict(ODD[1:])}
    rows = pii.personal_data(spark.createDataFrame(list(texts.items()), COLUMNS)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row["spans"] if s["base"])
        assert base == base_spans(texts[row["doc_id"]])
        ends = [0, *(s["end"] for s in row["spans"] if not s["base"])]
        assert ends == sorted(ends)
    assert pii.personal_data(empty(spark)).count() == 0


def test_added_personal_data(spark):
    """Among base spans: written out and national forms are added, what only looks alike is not."""
    wanted = [
        "mail me: joe.doe [at] mail [dot] example.org now", "tel 01 42 68 53 00 ok", "call (212) 555-0147 ok",
        "pay 4111 1111 1111 1111 2024 ok", "card 4111.1111.1111.1111 ok", "server 2001:db8:0:1:2:3:4:5 ok",
        "Tarjeta 5500/0000/0000/0004 ok", "host fe80::1ff:fe23:4567:890a ok", "Anruf 0171/5551234 ok",
    ]
    decoys = [
        "pay 4111 1111 1111 1112 2024 ok", "5d190b36974748794293dd8a", "total 612 345 678 units", "at 12:30:45 it ran",
        "version 1.2.3.400", "card 1234567890123456 ok", "std::add of 10:20", "x4111.1111.1111.1111x",
    ]
    plain = [f"write to p{n}@site{n}.com or +1 (212) 555-{1000 + n} from 10.0.{n}.7 with 4111111111111111" for n in range(60)]
    rows = list(enumerate(wanted)) + list(enumerate(decoys, 100)) + list(enumerate(plain, 200))
    found = {r["doc_id"]: [s for s in r["spans"] if not s["base"]] for r in pii.personal_data(spark.createDataFrame(rows, COLUMNS)).collect()}
    texts = dict(rows)
    added = {doc: [texts[doc][s["start"] : s["end"]] for s in spans] for doc, spans in found.items() if spans}
    assert added == {
        0: ["joe.doe [at] mail [dot] example.org"], 1: ["01 42 68 53 00"], 2: ["(212) 555-0147"], 3: ["4111 1111 1111 1111"],
        4: ["4111.1111.1111.1111"], 5: ["2001:db8:0:1:2:3:4:5"], 6: ["5500/0000/0000/0004"], 7: ["fe80::1ff:fe23:4567:890a"],
        8: ["0171/5551234"],
    }


def test_votes_are_weighed_by_their_reliability():
    def row(votes, count):
        return {"kind": "card", "count": count, **dict(zip(pii.LABELERS, votes))}

    counts = [row((1, 1, 0, 1), 60), (row((-1, -1, 0, -1), 60)), row((1, -1, 0, 1), 5), row((-1, 1, 0, -1), 20)]
    share, chance = pii.reliabilities(counts)
    assert 0.3 < share["card"] < 0.6
    assert pii.posterior(counts[2], share, chance) > 0.5 > pii.posterior(counts[3], share, chance)


def test_spotsigs(spark):
    texts = {4: "The cat of the dog ran to a big house", 5: "the CAT of the dog, ran to a big house!", 6: "Xa yb zc"}
    texts |= dict(ODD[1:])
    df = spark.createDataFrame([*texts.items(), (None, "the cat")], COLUMNS)
    rows = {r["doc_id"]: r for r in spotsigs.fingerprints(df).collect()}
    ids = sorted(texts)
    for place, doc in enumerate(ids):
        text, following = texts[doc] or "", texts[ids[(place + 1) % len(ids)]] or ""
        half = len(text) // 2
        assert rows[doc]["edited"] == text[: len(text) - half] + following[:half]
        assert rows[doc]["n_chars"] == len(text)
    assert rows[4]["signatures"] == rows[5]["signatures"] and rows[4]["near_next"] == 1.0
    assert rows[6]["signatures"] and rows[90]["signatures"] == [] and rows[90]["near_next"] == 1.0
    signed = spotsigs.with_signatures(df.where("doc_id > 0"), "text", "signatures")
    assert spotsigs.near_duplicates(signed).count() == 0
    close = [(n, list(range(20)) + [100 + n]) for n in range(3)] + [(9, list(range(50, 60)))]
    pairs = spotsigs.near_duplicates(spark.createDataFrame(close, "doc_id long, signatures array<int>")).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == [(0, 1), (0, 2), (1, 2)]
    assert spotsigs.fingerprints(empty(spark)).count() == 0


def test_spotsigs_do_not_depend_on_a_distant_common_word(spark):
    head, tail, other = (" ".join(f"{c}{n}x" for n in range(40)) for c in "kqz")
    anchored = [f"{head} {tail}", f"{head} the {tail}", f"{head} the {tail} of {other}"]
    edited = [f"{head} {other}", f"{head} {other}", f"{head} the {tail}"]
    rows = [(n, text) for n, text in enumerate(anchored + edited)]
    signed = spotsigs.with_signatures(spark.createDataFrame(rows, COLUMNS), "text", "signatures")
    found = {r["doc_id"]: set(r["signatures"]) for r in signed.collect()}
    for n in range(3):
        assert len(found[n]) > 60
        assert len(found[n] & found[n + 3]) >= 38
    shared = found[0] & found[1]
    assert len(shared) >= len(found[0]) - 2 * spotsigs.REACH
    assert len(found[1] - found[0]) <= 2


def test_language(spark):
    draw = random.Random(3)
    parts = {"aa": ["bla", "kro", "mip"], "bb": ["zun", "vex", "qor"]}

    def text(lang):
        return " ".join("".join(draw.choices(parts[lang], k=2)) for _ in range(30))

    rows = [(1000 + n, text(lang), lang) for n, lang in enumerate(["aa", "bb"] * 60)]
    model = language.train(language.training_sample(spark.createDataFrame(rows[:80], f"{COLUMNS}, lang string")))
    df = spark.createDataFrame([*((i, t) for i, t, _ in rows[80:]), *ODD[:4], (99, "123 !")], COLUMNS)
    found = {r["doc_id"]: r["f"] for r in df.select("doc_id", language.identify(df, model).alias("f")).collect()}
    assert all(found[i]["lang"] == lang and found[i]["accepted"] for i, _, lang in rows[80:])
    assert all(found[i]["lang"] == "und" and not found[i]["accepted"] for i in (90, 91, 92, 99))
    assert found[None]["lang"] in parts
    none = df.select(language.identify(df, language.train([])).alias("f")).select("f.lang").distinct().collect()
    assert [r["lang"] for r in none] == ["und"]


def test_language_rejects_what_it_has_not_learned(spark):
    """Texts of other syllables are rejected, held-out rows and short texts are not."""
    draw = random.Random(5)
    vowels = {"aa": "aeo", "bb": "eiu", "cc": "aou", "dd": "uyo"}
    consonants = {"aa": "brtn", "bb": "plsn", "cc": "dgmt", "dd": "kzvx"}

    def text(lang, words):
        syllables = [c + v for c in consonants[lang] for v in vowels[lang]]
        return " ".join("".join(draw.choices(syllables, k=draw.randrange(1, 4))) for _ in range(words))

    rows = [(n, text(lang, 60), lang) for n, lang in enumerate(["aa", "bb", "cc"] * 120)]
    rows += [(1, rows[1][1], rows[1][2])] * 50 + [(None, "x", "aa"), (2, None, "aa"), (3, "x", None)]
    df = spark.createDataFrame(rows, f"{COLUMNS}, lang string")
    sample = language.training_sample(df, rows=80)
    assert sorted(lang for _, lang in sample) == ["aa"] * 80 + ["bb"] * 80 + ["cc"] * 80
    assert len(set(sample)) == len(sample)
    model = language.train(sample)
    known = [(n, text(lang, words)) for n, (lang, words) in enumerate([(x, w) for x in ("aa", "bb", "cc") for w in (4, 40, 400)] * 20)]
    unknown = [(1000 + n, text("dd", 40)) for n in range(60)] + [(2000, "日本語の文章はここにあります。" * 3)]
    both = spark.createDataFrame([*known, *unknown], COLUMNS)
    accepted = {r["doc_id"]: r["f"]["accepted"] for r in both.select("doc_id", language.identify(both, model).alias("f")).collect()}
    assert sum(accepted[n] for n, _ in known) >= 0.98 * len(known)
    assert not any(accepted[n] for n, _ in unknown)
    assert both.where("false").select(language.identify(both, model)).count() == 0
    assert language.training_sample(df.where("false")) == []


def test_many_languages_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "DIMENSIONS", 4)
    rows = [(n, " ".join([f"{'abcdefghij'[n % 10] * 3}{'xyz'[k % 3]}" for k in range(20)]), f"l{n % 10}") for n in range(200)]
    model = language.train(language.training_sample(spark.createDataFrame(rows, f"{COLUMNS}, lang string")))
    assert len(model.languages) == 10 and model.table.shape[1] == 4
    df = spark.createDataFrame(rows, f"{COLUMNS}, lang string")
    found = df.select("lang", language.identify(df, model)["lang"].alias("told")).collect()
    assert sum(r["lang"] == r["told"] for r in found) >= 180


def test_toxicity(spark):
    draw = random.Random(3)
    words = [f"word{n}" for n in range(300)]
    rows = []
    for n in range(400):
        text = draw.choices(words, k=30)
        if n % 4 == 0:
            text[draw.randrange(30)] = draw.choice(["vile", "nasty"])
        rows.append((n, " ".join(text), int(n % 4 == 0)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + ODD, COLUMNS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]] + [(500, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(*toxicity.training_sample(df, labels))
    found = {r["doc_id"]: r["s"] for r in df.select("doc_id", toxicity.score(df, model).alias("s")).collect()}
    right = sum((found[i] >= 0.5) == bool(y) for i, _, y in rows[300:])
    assert right >= 95 and found[90] == found[91] < 0.5
    assert toxicity.train([], 0.0) is None


def test_digests_are_of_real_texts(spark, tmp_path):
    rows = [(1, "the a@b.co of", "en", "s", 13), (2, None, None, "s", 0)]
    spark.createDataFrame(rows, f"{COLUMNS}, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    row = {r["doc_id"]: r for r in queries.op10_pii(spark, str(tmp_path)).collect()}[1]
    assert row["base_sha256"] == hashlib.sha256(b"email:4:10").hexdigest() and row["n_email"] == 1


def test_pii_counts_are_of_base_spans(spark, tmp_path):
    """Spans that the method adds are in ``spans`` but not in the counts."""
    texts = ["tel 01 42 68 53 00 ok", "call (212) 555-0147 ok", "card 4111.1111.1111.1111 ok", "server 2001:db8:0:1:2:3:4:5 ok"]
    texts += [f"write to p{n}@site{n}.com or +1 (212) 555-{1000 + n} from 10.0.{n}.7 with 4111111111111111" for n in range(60)]
    rows = [(n, t, "en", "s", len(t)) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, f"{COLUMNS}, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    assert any(r["spans"] for n, r in found.items() if n < 4)
    for n, text in enumerate(texts):
        base = base_spans(text)
        assert found[n]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        for kind in pii.KINDS:
            assert found[n][f"n_{kind}"] == sum(s.split(":")[0] == kind for s in base.split(",") if s)


def test_toxicity_learns_from_every_labelled_row(spark):
    """Rows beyond any sample teach the model: here the toxic word is only in the last labelled rows."""
    draw = random.Random(8)
    words = [f"w{n}" for n in range(200)]
    rows = []
    for n in range(4000):
        text = draw.choices(words, k=20)
        if n % 4 == 0:
            text[draw.randrange(20)] = "vile" if n < 400 else "rotten"
        rows.append((n, " ".join(text), int(n % 4 == 0)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + ODD, COLUMNS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(500, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert len(model.features) > 200 and "rotten" not in words
    found = {r["doc_id"]: r["s"] for r in df.select("doc_id", toxicity.score(df, model).alias("s")).collect()}
    right = sum((found[i] >= 0.5) == bool(y) for i, _, y in rows[3000:])
    assert right >= 950 and found[90] == found[91] < 0.5
    assert toxicity.fit(df, labels.where("toxic = 0")) is None
