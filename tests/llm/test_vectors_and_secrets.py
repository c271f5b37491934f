"""Clustering, vector codes and secret scans against plain code."""

import hashlib
import math
import os
import random

import brute
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lonja.llm import clustering, queries, secrets, vector_codes, vectors
from lonja.runtime import drop_staged

KIND = "vec_id bigint, embedding array<float>, label int"


def blobs(count, dims, seed=3, groups=5):
    """Vectors around a few centres, in single precision; every seventh repeats another."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.6, (groups, dims))
    rows = (centres[rng.integers(0, groups, count)] + rng.normal(0, 0.15, (count, dims))).astype(np.float32)
    rows[7::7] = rows[: len(rows[7::7])]
    return {n: row.tolist() for n, row in enumerate(rows)}


def table(spark, rows):
    return spark.createDataFrame([(i, v, None if i is None or i % 3 == 0 else i % 2) for i, v in rows], KIND)


def written(tmp_path, df, name="embeddings"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


UNUSABLE = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [math.nan] * 64), (905, [math.inf] + [0.0] * 63)]


def test_clusters_equal_plain_code(spark, tmp_path):
    data = blobs(300, 64)
    folder = written(tmp_path, table(spark, [*data.items(), *UNUSABLE]).withColumn("cluster", F.lit("own")).repartition(5))
    rows = queries.op11_centroid_clustering(spark, folder).collect()
    expected = brute.clusters(data)
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in rows} == {i: e[:2] for i, e in expected.items()}
    inertia = {}
    for own, distance, _ in expected.values():
        inertia[own] = inertia.get(own, 0) + distance
    for r in rows:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        centroid = ",".join(map(str, expected[r["vec_id"]][2]))
        assert r["centroid_sha256"] == hashlib.sha256(centroid.encode()).hexdigest()


def test_bounds_spare_evaluations_and_never_change_the_result():
    rng = np.random.default_rng(5)
    data = np.array(list(blobs(2000, 16, groups=12).values()))
    x = np.floor(64 * data).astype(np.int64)
    history = x[rng.choice(len(x), 12, replace=False)][None]
    own, near, seen, evaluated = clustering._Bounds(x, history).first()
    spent = []
    for _ in range(5):
        means = np.stack([x[own == j].sum(axis=0) // max((own == j).sum(), 1) if (own == j).any() else history[-1][j] for j in range(12)])
        history = np.concatenate([history, means[None]])
        own, near, seen, evaluated = clustering._Bounds(x, history).again(own, near, seen)
        exact = ((x[:, None] - history[-1]) ** 2).sum(axis=2)
        assert (own == exact.argmin(axis=1)).all()
        spent.append(evaluated.mean())
    assert spent[-1] < 3 < 12


def test_bounds_follow_the_total_displacement_not_the_path():
    # the other centroid goes away and comes back: summed drifts would reopen it, the total is zero
    x = np.array([[0, 0]])
    there, far = [[1, 0], [40, 0]], [[1, 0], [40, 60]]
    history = np.array([there, far, there])
    state = clustering._Bounds(x, history[:1]).first()[:3]
    state = clustering._Bounds(x, history[:2]).again(*state)[:3]
    *state, evaluated = clustering._Bounds(x, history).again(*state)
    assert state[0].tolist() == [0] and evaluated.tolist() == [0]


def test_clusters_of_ties_repeated_ids_and_few_vectors(spark):
    same = [0.5] * 64
    found = clustering.cluster(table(spark, [(1, same), (1, same), (2, same), (None, same)])).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found) == [("1", 0, 0), ("1", 0, 0), ("2", 0, 0), ("None", 0, 0)]
    empty = clustering.cluster(table(spark, UNUSABLE))
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]
    with pytest.raises(PySparkException):
        clustering.cluster(table(spark, [(1, [4e6] * 64)])).collect()


def test_operators_leave_only_what_their_result_reads(spark):
    drop_staged(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/lonja-{spark.sparkContext.applicationId}"
    clustering.cluster(table(spark, blobs(40, 64).items())).collect()
    vector_codes.compress(table(spark, blobs(40, 64).items())).collect()
    assert sorted(n.rsplit("-", 1)[0] for n in os.listdir(folder)) == ["label-errors", "vector-codes", "vector-distances"]
    drop_staged(spark)


def test_trie_equals_a_full_scan():
    rng = np.random.default_rng(2)
    for spread, dims in ((2, 3), (4, 6), (300, 4), (2, 1)):
        rows, number = vector_codes.distinct_rows(rng.integers(-spread, spread, (400, dims)))
        assert (np.diff(number[np.lexsort(rows[number].T[::-1])]) >= 0).all()
        entries = rng.integers(-spread, spread, (37, dims))
        far = ((rows[:, None] - entries) ** 2).sum(axis=2)
        entry, distance = vector_codes.nearest_entries(rows, entries)
        assert (entry == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_codes_equal_plain_code(spark, tmp_path):
    data = blobs(320, 64, seed=8)
    folder = written(tmp_path, table(spark, [*data.items(), *UNUSABLE]).withColumn("code", F.lit(1)).repartition(3))
    rows = queries.op12_vector_codes(spark, folder).collect()
    expected, books = brute.vector_codes(data, 4, 256, 4)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in rows} == expected
    assert {r["codebooks_sha256"] for r in rows} == {books}
    label = {i: None if i % 3 == 0 else i % 2 for i in data}
    for r in rows:
        assert r["label_error"] == sum(e for i, (_, e) in expected.items() if label[i] == label[r["vec_id"]])


def test_codes_of_other_shapes_and_of_nothing(spark):
    data = blobs(50, 6)
    found = vector_codes.compress(table(spark, data.items()), parts=3, entries=8, rounds=2, dims=6).collect()
    expected, _ = brute.vector_codes(data, 3, 8, 2)
    assert {r["vec_id"]: (r["code"].hex(), r["error"]) for r in found} == expected
    assert vector_codes.compress(table(spark, UNUSABLE)).count() == 0
    repeated = vector_codes.compress(table(spark, [(None, [0.25] * 64), (4, [0.5] * 64), (4, [0.5] * 64)])).collect()
    assert sorted((str(r["vec_id"]), r["code"].hex()) for r in repeated) == [("4", "00" * 4), ("4", "00" * 4), ("None", "02" * 4)]
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, data.items()), parts=5)


def test_sums_beyond_64_bits_are_exact(spark):
    rows = [(0, 1, [(1 << 62), -7]), (0, 2, [(1 << 62), -7]), (0, 1, [(1 << 62), -7])]
    parts = spark.createDataFrame(rows, "cluster int, n bigint, sums array<bigint>")
    assert vectors.exact_means(parts, "cluster") == {(0,): [3 * (1 << 62) // 4, -6]}


def ordinary_text(words, seed):
    rng = random.Random(seed)
    kinds = "the quick brown Fox jumps over lazy Dogs and 12 cats of 1999 in a deed Facade cafe; internationalisation".split()
    return " ".join(rng.choice(kinds) for _ in range(words))


HEX40 = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
TEXTS = [
    "",
    None,
    f'x token = "{HEX40}" y',
    "API_KEY: abc.def-1 apikey='short' PassWd=abcdef Password : 12345",
    f"é AKIA{'Q' * 16} AKIAQ {HEX40[:24]} {HEX40[:23]}",
    f"tokentoken=abcdefg ſecret=abcdefg toKen=abcdefg\n{HEX40}é{HEX40}",
    "token=token=abcdefgh secret  =  'zzzzzz' secret\t=zzzzzz",
    "a" * 30 + " " + "7" * 40 + "/" + "0f" * 30,
]


def test_base_secrets_equal_plain_patterns(spark, tmp_path):
    rng = random.Random(4)
    bits = ["token", "SECRET", "api_key", "apikey", "passwd", " ", "  ", "=", ":", '"', "'", HEX40, HEX40[:23], "AKIA", "QWERTY0123456789", "é", "\n", "abcdef"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    found = queries.op13_secret_scans(spark, written(tmp_path, docs.repartition(3), "documents")).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = brute.base_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest(), texts[r["doc_id"]]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == (expected.split(",") if expected else [])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [expected.count(kind) for kind in ("assign:", "access:", "hex:")]


def test_random_tokens_are_added_and_ordinary_ones_left(spark):
    rng = random.Random(9)
    alphabets = [a for name, a in secrets.ENCODINGS.items() if name not in ("hex", "hex_upper")]
    texts, planted = [], {}
    for n in range(400):
        text = ordinary_text(900, n) + " some-ordinary-identifier_with_parts SomeOrdinaryIdentifierName 20240229120000123 "
        if n % 4 == 0:
            token = "".join(rng.choice(alphabets[n // 4 % len(alphabets)]) for _ in range(40))
            planted[n] = (len(text), len(text) + 40)
            text += token + ("==" if n % 8 == 0 else "") + " "
        texts.append(text + ordinary_text(20, -n))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    caught = 0
    for r in secrets.secrets(docs).collect():
        added = [s for s in r["spans"] if s["kind"] == "random"]
        if r["doc_id"] not in planted:
            assert not added, texts[r["doc_id"]][added[0]["start"] : added[0]["end"]]
        for s in added:
            start, end = planted[r["doc_id"]]
            assert abs(s["start"] - start) <= 3 and abs(s["end"] - end) <= 3 and not s["base"]
            caught += 1
    assert caught >= 0.9 * len(planted)


def test_battery_accepts_random_tokens_and_rejects_patterns():
    rng = np.random.default_rng(6)
    for number, alphabet in enumerate(secrets._ALPHABETS):
        lengths = np.full(3000, 32)
        score = secrets.battery(alphabet[rng.integers(0, len(alphabet), 3000 * 32)], lengths, number)
        assert (score > secrets.RANDOM).mean() < 0.003
    base62 = list(secrets.ENCODINGS).index("base62")
    tokens = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ012345abcdefghijkl", "A1" * 24, "internationalizationInternationalizationsxx", "a" * 47 + "B"]
    data = np.frombuffer("".join(tokens).encode(), np.uint8)
    assert (secrets.battery(data, np.array([len(t) for t in tokens]), base62) > secrets.RANDOM).all()


def test_discovery_is_controlled_by_length_and_by_ordinary_text():
    ordinary = {(5, 3, 10): 5, (5, 3, 65): 99_994, (5, 0, 10): 60_000, (5, 0, 65): 40_000}
    assert secrets.accepted_bins(ordinary, {}) == {}
    passed = secrets.accepted_bins(ordinary, {(5, 3, 10): 50, (5, 0, 10): 50, (5, 3, 64): 5})
    assert passed == {(5, 3): 10}
    # what most tokens of a length look like is no discovery
    assert secrets.accepted_bins({(3, 1, 5): 200, (3, 1, 40): 40_000, (3, 1, 65): 59_800}, {(3, 1, 5): 10, (3, 1, 40): 9_990}) == {}
    # without text to compare with nothing can be told
    assert secrets.accepted_bins({}, {(5, 3, 10): 50}) == {}


def test_secrets_of_an_empty_table_and_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, f"token={HEX40}"), (7, None), (7, "AKIA" + "Z" * 16)], "doc_id string, text string")
    rows = [(r["doc_id"], [s["kind"] for s in r["spans"]]) for r in secrets.secrets(docs).collect()]
    assert sorted(rows, key=str) == [("7", ["access"]), ("7", []), (None, ["assign", "hex"])]
    assert secrets.secrets(docs.where("false")).count() == 0


def test_a_long_text_is_read_whole(spark):
    text = ordinary_text(400_000, 1) + f" {HEX40}"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    spans = secrets.secrets(docs).first()["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("hex", len(text) - 40, len(text))]
