"""Stages and operators on odd tables, and whole queries against plain versions of them."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("loglattice.llm")

from loglattice.llm import common, quality, secrets, simhash, toxicity  # noqa: E402

#: Names that operators use inside, and a column that begins with an underscore.
ODD = ["row", "base", "odd", "every", "score", "k", "fp", "rep", "key", "node", "root", "v", "_base", "keep", "component_id", "tests"]


def odd_table(spark, rows):
    fields = ", ".join(f"`{c}` string" for c in ODD)
    return spark.createDataFrame([(i, t, *(f"{c}{n}" for c in ODD)) for n, (i, t) in enumerate(rows)], f"doc_id long, text string, {fields}")


LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def rows():
    rng = random.Random(3)
    say = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n))
    out = [(i, say(40)) for i in range(30)]
    return [*out, (40, None), (41, None), (42, ""), (43, " \n"), (50, LONG), (51, LONG + " end"), (60, out[0][1]), (60, out[0][1]), (None, out[1][1]), (None, None), (70, "password=hunter22long and é"), (71, say(3))]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of the kind is in any of these at all"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_on_odd_tables(spark, folder):
    import corpus_pipeline

    common.reach(spark)
    docs = odd_table(spark, rows())
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, folder)
        none = stage(spark, docs.limit(0), folder)
        assert none.count() == 0 and none.columns == left.columns
        found = left.collect()
        if name == "byte_bpe":
            assert len(found) == docs.count()
            continue
        assert left.schema == docs.schema or [x.dataType for x in left.schema] == [x.dataType for x in docs.schema] and left.columns == docs.columns
        given = collections.Counter(tuple(r)[2:] for r in docs.collect())
        assert collections.Counter(tuple(r)[2:] for r in found) <= given  # columns of any name are carried as they are
        ids = collections.Counter(r.doc_id for r in found)
        if name == "near_dedup":
            # Of documents without words one stays, of equal and near ones the smallest id; repeated rows of an id stay together, and rows without an id stay.
            assert [i for i in (40, 41, 42, 43) if ids[i]] == [40] and ids[50] == 1 and ids[51] == 0 and ids[60] == 0 and ids[0] == 1 and ids[None] == 2 and ids[71] == 1
        if name == "decontamination":
            assert ids == collections.Counter(i for i, _ in rows())
        if name == "secret_scan":
            texts = collections.Counter((i, t.replace("password=hunter22long", "[SECRET]") if t else t) for i, t in rows())
            assert collections.Counter((r.doc_id, r.text) for r in found) == texts


def test_shared_folder_is_asked_for(spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def plain_log10_p(token):
    """The battery on one candidate, by numpy."""
    k = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token) else 32 if re.fullmatch("[A-Z2-7]+=*", token) else 64
    body = token.rstrip("=")
    n = len(body)
    chi = k / n * sum(c * c for c in collections.Counter(body).values()) - n
    uniform = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
    classes = [kind(c) for c in body]
    changes = sum(a != b or a not in "aA0" for a, b in zip(classes, classes[1:]))
    rate = {16: 2 * (10 / 16) * (6 / 16), 32: 2 * (26 / 32) * (6 / 32), 64: 1 - 2 * (26 / 64) ** 2 - (10 / 64) ** 2 - 2 / 64**2}[k]
    runs = (changes - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate) * 1.5)
    codes = np.array([secrets.CODES.index(c) + 1 for c in body], float)
    codes -= codes.mean()
    serial = math.sqrt(n) * (codes[:-1] * codes[1:]).sum() / (codes * codes).sum() if (codes * codes).sum() else None
    if n < 20 or uniform > secrets.REJECT_Z or abs(runs) > secrets.REJECT_Z or serial is None or abs(serial) > secrets.REJECT_Z:
        return None
    surplus = max(k * secrets.PROSE_COINCIDENCE - 1, 0.5)
    z = (chi - (k - 1) - n * surplus) / math.sqrt(2 * (k - 1) + 4 * n * surplus)
    first = -z * z / 2 - math.log(2) if z < 0 else math.log(1 - 0.5 * math.exp(-z * z / 2))
    share, p = min(changes / (n - 1), 0.999), secrets.PROSE_CHANGE
    second = -(n - 1) * (share * math.log(share / p) + (1 - share) * math.log((1 - share) / (1 - p))) if share > p else 0.0
    return min(0.0, min(first, second) + math.log(2)) / math.log(10)


def planted(rng, n):
    """Texts with random strings and with names, paths and long words; and where the random strings are."""
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9)))
    texts, true = [], []
    for i in range(n):
        parts = [word() for _ in range(20)]
        parts.insert(5, "get" + "".join(word().capitalize() for _ in range(4)))
        parts.insert(9, "/usr/local/" + "/".join(word() for _ in range(3)) + "/v2")
        parts.insert(12, "_".join(word() for _ in range(5)) + "_2024")
        if i % 3 == 0:
            secret = "".join(rng.choice(b64 if i % 2 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(rng.choice([32, 40, 64])))
            parts.insert(15, secret)
            true.append((i, len(" ".join(parts[:15])) + 1, secret))
        texts.append(" ".join(parts))
    return texts, true


def test_battery_like_numpy(spark):
    """The whole scan against a plain one: candidates, p-values, weights and the step-up; power and false discoveries measured."""
    texts, true = planted(random.Random(4), 300)
    found = {r.doc_id: r.spans for r in secrets.secrets(odd_table(spark, list(enumerate(texts)))).collect()}
    tested = [(i, m.start(), m.end(), plain_log10_p(m[0])) for i, t in enumerate(texts) for m in re.finditer(secrets.CANDIDATE, t) if re.search("[0-9]|[a-z][A-Z]", m[0])]
    mean = np.mean([b - a for _, a, b, _ in tested])
    scored = [(i, a, b, p - math.log10((b - a) / mean)) for i, a, b, p in tested if p is not None]
    bins = collections.Counter(min(int(-min(p, 0.0) * secrets.BINS_PER_DECADE), secrets.LAST_BIN) for *_, p in scored)
    limit, count = float("-inf"), 0
    for one in sorted(bins, reverse=True):
        count += bins[one]
        if 10 ** (-one / secrets.BINS_PER_DECADE) * len(tested) <= secrets.FDR * count:
            limit = -one / secrets.BINS_PER_DECADE
    expected = collections.defaultdict(list)
    for i, a, b, p in scored:
        if p <= limit:
            expected[i].append(f"random:{a}:{b}")
    assert found == {i: ",".join(expected[i]) for i in range(len(texts))}
    told = {(i, int(x.split(":")[1])) for i, spans in found.items() for x in spans.split(",") if x}
    there = {(i, a) for i, a, _ in true}
    # A good part of base 32 differs too little from prose at this rate; all of base 64 is found.
    assert len(told & there) >= 0.7 * len(there) and len(told - there) <= 0.03 * len(told)
    assert {(i, a) for i, a, x in true if not re.fullmatch("[A-Z2-7]+", x)} <= told


def test_scores_of_a_fixed_model(spark):
    """Operator 6 scores by the sum of the weights of a text's features, whole texts included."""
    model = toxicity.Linear(-1.0, {"nasty": 2.0, "nast*1": 0.5, "nast*2": 1.0, "calm": -1.5})
    docs = [(1, "Nasty, nasties!"), (2, "calm"), (3, None), (4, ""), (5, LONG + " nasty"), (5, LONG + " nasty")]
    got = sorted((r.doc_id, r.score) for r in toxicity.scored(odd_table(spark, docs), model).collect())
    logit = lambda t: model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features_of(t))
    want = sorted((i, 1 / (1 + math.exp(-logit(t)))) for i, t in docs)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


def test_whole_simhash_query(spark):
    """Fingerprints and components of the query against a bit by bit count."""
    import xxhash

    texts = [*rows()[:20], (40, None), (41, ""), (42, "A b"), (43, "a B"), (50, "x " * 300), (51, "x " * 301)]

    def bits(text):
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))

    prints = {i: bits(t) for i, t in texts}
    groups = {i: i for i in prints}
    for _ in prints:
        groups = {i: min(groups[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_table(spark, texts)).collect()}
    assert found == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


def test_quality_of_odd_rows(spark, folder):
    docs = odd_table(spark, rows())
    found = quality.quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in rows()) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
