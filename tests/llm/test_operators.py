"""Operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteaudit.llm import components, decontaminate, licenses, mixing, near_dedup, pii, queries, sharding, syncmers, token_files, toxicity, url_filter
from siteaudit.llm import textblocks as tb
from siteaudit.llm.shared import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


LONG = "lorem ipsum Äpfel dolor sit amet 42 " * 30_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (4, "Mit License, GNU General  Public License", "en", "b", 1),
    (None, "no id here at all", "de", None, 5), (5, LONG, "de", "a", len(LONG)), (6, "one", "xx", "a", 3), (7, " \t\n\x0b\x1c ÀÉ", "fr", "c", 9), (8, "x" * 50_000, "fr", "c", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, sf, duck, rows_of):
    assert rows_of(queries.QUERIES[name](spark, sf)) == rows_of(duck.execute(queries.ORACLES[name]))


def test_words():
    for letters, pattern in ((tb.ALNUM, ALNUM), (tb.NONSPACE, SPACED)):
        rows = [t for _, t, *_ in ODD]
        for block in tb.blocks(pa.array(rows), 100):
            w = tb.words(block, letters)
            data = tb.LOWER[block.raw].tobytes()
            for r in range(block.hi - block.lo):
                a, b = w.first[r], w.first[r + 1]
                assert [data[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] == re.findall(pattern, low(rows[block.lo + r]))


# ---- 1 ----
def test_url_filter(spark):
    urls = [None, "", "x", "HTTP://A.Net/", "http://net", "http://net/", "http://xnet/", "http://b.example.net/en/1", "http://b.example.net/en", "https://example.com/de/#", "http://k.org/fr/?", "a://b://c.net/", "http://.net/", "http://e.net?x/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    out = url_filter.judge_urls(pages)
    assert out.count() == 28 and [c for c in out.columns if "rule" in c] == ["rule", "_rule"]

    def brute(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")

    for way in (out, url_filter.judge_urls(pages, max_bytes=8), url_filter.judge_urls(pages.repartition(3))):
        for r in way.collect():
            assert (r["host"], r["path"], r["_rule"], r["verdict"]) == brute(r["url"]), r["url"]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0 and url_filter.judge_urls(pages, []).where("verdict = 'block'").count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), (F.col("id") % 7 == 0).alias("listed"))
    c = url_filter.build_cascade(keys)
    rows = keys.toPandas()
    got = c.listed(rows.h1.to_numpy().view(np.uint64), rows.h2.to_numpy().view(np.uint64))
    assert len(c.levels) > 2 and (got == rows.listed.to_numpy()).all() and url_filter.build_cascade(keys, max_bytes=100) is None
    # The same answers from parts under a bound.
    parts = url_filter.build_cascades(keys, max_bytes=2_000)
    assert len(parts.parts) > 1 and all(sum(8 * len(v.bits) for v in p.levels) <= 2_000 for _, _, p in parts.parts)
    assert (parts.listed(rows.h1.to_numpy().view(np.uint64), rows.h2.to_numpy().view(np.uint64)) == rows.listed.to_numpy()).all()


def test_long_urls_and_ties(spark):
    long = "http://" + "a." * 50_000 + "net/en/" + "x" * 100_000
    rules = (("block", "ab.net", "/x"), ("allow", "net", "/abxy"), ("block", "example.net", "/en/"))
    pages = spark.createDataFrame([(1, long), (2, "http://ab.net/x"), (3, "http://ab.net/abxyz")], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert (got[1]["rule"], got[1]["verdict"], len(got[1]["host"])) == ("net/", "block", 100_003)
    tied = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert tied == {1: (None, "allow"), 2: ("ab.net/x", "block"), 3: ("net/abxy", "allow")}


# ---- 2 ----
def test_chain_equals_padded_forward_backward():
    rng = np.random.default_rng(1)
    n, width = 40, 50
    model = toxicity.Model(toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int8)), rng.normal(size=(toxicity.GROUPS, toxicity.BINS)), -0.4, rng.normal(size=(2, 2)), np.zeros(3))
    model.weights[:, 0] = 0
    first = np.concatenate(([0], np.cumsum(rng.integers(0, width, n))))
    word = ((rng.random(first[-1]) < 0.1) * rng.integers(1, toxicity.BINS, first[-1])).astype(np.int8)
    bins = toxicity.emissions(word, word[::-1].copy(), first)
    d = model.bias + sum(model.weights[g][bins[:, g]] for g in range(toxicity.GROUPS))
    padded, live = np.zeros((n, width)), np.zeros((n, width), bool)
    for i in range(n):
        k = first[i + 1] - first[i]
        padded[i, :k], live[i, :k] = d[first[i] : first[i + 1]], True
    full = toxicity._marginals(padded, live, model.moves)[0]
    full = np.concatenate([full[i, : first[i + 1] - first[i]] for i in range(n)])
    at = np.flatnonzero(bins.any(axis=1))
    assert np.abs(full[at] - toxicity.Chain(model).run(at, d[at], np.searchsorted(first, at, "right") - 1, first)).max() < 1e-12


def test_toxicity(spark, odd, none, sf):
    rng = random.Random(3)
    plain = ["".join(rng.choice(["ba", "ko", "ri", "nu", "se", "ta"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    made, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 90))]
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["vileword", "grimmix" + rng.choice(plain)]))
        made.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    corpus, marks = spark.createDataFrame(made, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_digest(corpus, marks).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    test = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in test) / len(test) > 0.98
    model = toxicity.trained(corpus, marks)
    out, score, spans = toxicity.score_documents(spark.createDataFrame([(1, "ÄÖ vileword!", 2.0)], "doc_id long, text string, score double"), model)
    r = out.first()
    assert score == "_score" and [(s["start"], s["end"]) for s in r[spans]] == [(3, 11)]
    assert toxicity.score_documents(odd, model)[0].where(f"{'score'} BETWEEN 0 AND 1").count() == len(ODD)
    assert toxicity.score_documents(none, model)[0].count() == 0
    assert toxicity.toxicity_digest(odd, marks.limit(0)).where("predicted = 0").count() == len(ODD)
    assert {r["doc_id"] for r in toxicity.remove_toxic(corpus, marks).collect()} >= {i for i in range(900) if i % 5}


# ---- 3 ----
def test_rare_toxic_words(spark):
    # A word of 11 of 1,200 toxic documents (0.9 %) is learned; a word of both kinds is not.
    made = [(f"ba ko ri {'rareslur' if i < 11 else 'nu'} vileword", 1) for i in range(1_200)] + [("ba ko ri nu se", 0)] * 1_200
    rows = spark.createDataFrame(made, "text string, y int")
    word = lambda t: {int(h[0]) for h in toxicity.features(tb.words(next(tb.blocks(pa.array([t]))), tb.ALNUM))}
    names, odds = toxicity._odd_features(rows, 1_200, 1_200)
    got = set(names.view(np.uint64).tolist())
    assert word("rareslur") - {0} <= got and word("vileword") - {0} <= got and not (word("ba") | word("nu")) & got and odds.min() >= toxicity.MIN_ODDS
    labels = [(i, f"{t} {i}", y) for i, (t, y) in enumerate(made)]
    model = toxicity.train(spark.createDataFrame(labels, "doc_id long, text string, toxic int"))
    assert (word("rareslur") - {0}) <= set(model.lexicon.keys.tolist())


def spark_hash(*values):
    """xxhash64 of Spark: each value's bytes, seeded by the hash so far; nulls leave it as it is."""
    import struct

    import xxhash

    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q", v) if not isinstance(v, np.int32) else struct.pack("<i", v)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - 2**64 if h >= 2**63 else h


def brute_places(rows, keys, n_shards, seed=20240229):
    """(shard, slot) of rows of values, of which the first is the id: exact integers, no Spark."""
    ties = [spark_hash(*r) for r in keys]
    order = sorted(range(len(rows)), key=lambda i: (spark_hash(rows[i][0], ties[i]) % sharding.BUCKETS, rows[i][0] is not None, rows[i][0] or 0, ties[i]))
    n = len(rows)
    a = int(np.sqrt(max(n - 1, 0))) + 1
    b = max(1, -(-n // a))

    def once(x):
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + spark_hash(np.int32(seed), np.int32(i), right) % a) % a
            else:
                right = (right + spark_hash(np.int32(seed), np.int32(i), left) % b) % b
        return left * b + right

    out = [None] * n
    for row, i in enumerate(order):
        x = once(row)
        while x >= n:
            x = once(x)
        out[i] = x % n_shards, x // n_shards
    return out


def test_sharding_by_hand(spark, docs, odd):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        want = sorted(zip([str(d) for d, _ in rows], brute_places(rows, rows, 16)))
        assert sorted((str(r["doc_id"]), (r["shard"], r["slot"])) for r in sharding.shard_digest(df).collect()) == want


def test_sharding(spark, odd, none):
    for n in (1, 2, 3, 5, 17, 1000):
        assert sorted(r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 7)).collect()) == list(range(n))
    got = sharding.shard_digest(odd, shards=3).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    sizes = [sum(r["shard"] == s for r in got) for s in range(3)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(ODD)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    clash = sharding.shard_documents(odd.withColumn("shard", F.lit(9)).withColumn("part", F.lit(1)))
    assert clash.columns[-2:] == ["_shard", "slot"] and clash.count() == len(ODD) and sharding.shard_digest(none).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_digest(odd.repartition(3), shards=3).collect()))


# ---- 4 ----
def brute_pii(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(found)]


def test_base_spans():
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice("a1 @.+-()é9%4") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_pii(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_personal_data(spark, odd, docs, texts, none):
    for r in pii.personal_data_digest(docs).collect():
        base = brute_pii(texts[r["doc_id"]])
        line = pii.spans_text(base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["n_email"] == sum(k == "email" for k, *_ in base)
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
    assert pii.personal_data_digest(odd).count() == len(ODD) and pii.personal_data_digest(none).count() == 0
    assert pii.find_personal_data(odd.withColumn("spans", F.lit(1)), pii.fit_texts([]))[1] == "_spans"
    field = pii.fit_texts(["call +1 (488) 555-2485 now, yes +1 (488) 555-2485", "mail a.b@c.de", "see 10.2.3.4", "pay 4111111111111111 ok", "no 123 or abc1"] * 20)
    assert field.skip > 1
    base, more = pii.all_spans("call +1 (488) 555-2485 and later 1 (488) 555-2485 again", field)
    assert [k for k, *_ in base] == ["phone"] and [k for k, *_ in more] == ["phone", "phone"]
    masked = pii.mask_personal_data(spark.createDataFrame([(1, "é mail a.b@c.de now"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in masked] == ["é mail <email> now", None]


def test_belief_propagation_on_trees():
    rng = np.random.default_rng(0)
    emit = rng.normal(size=(4, 3))
    field = pii.Field(np.zeros((3, 1)), 0.7, 1.3)
    got = pii.marginals(emit, [(0, 1), (1, 2)], [(1, 3)], field, 20)
    want = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(emit[i, y[i]] for i in range(4)) + 0.7 * ((y[0] == y[1]) + (y[1] == y[2])) + 1.3 * (y[1] == y[3]))
        for i in range(4):
            want[i, y[i]] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_belief_on_a_loop():
    # Loopy messages are approximate: close to all labellings on a loop of weak edges, and as certain of the same labels on one of strong ones.
    rng = np.random.default_rng(2)
    for chain, skip, far in ((0.3, 0.4, 0.02), (0.7, 2.0, 0.3)):
        emit = rng.normal(size=(4, 3))
        got = pii.marginals(emit, [(0, 1), (1, 2), (2, 3)], [(0, 3)], pii.Field(np.zeros((3, 1)), chain, skip))
        want = np.zeros((4, 3))
        for y in np.ndindex(3, 3, 3, 3):
            p = np.exp(sum(emit[i, y[i]] for i in range(4)) + chain * sum(y[i] == y[i + 1] for i in range(3)) + skip * (y[0] == y[3]))
            for i in range(4):
                want[i, y[i]] += p
        want /= want.sum(1, keepdims=True)
        assert np.abs(got - want).max() < far and (got.argmax(1) == want.argmax(1)).all()


def test_personal_data_in_long_runs():
    import time

    field = pii.fit_texts([])
    n = 1_000_000
    for text in ("x" * n + " 1", "1" * n, "1." * (n // 2), "0" * n + ".1.2.3 ", "a@" * (n // 2), "+1" + "(" * n, "x" * n + "@" + "y" * n, "1 " * (n // 2), "+" * n + "1", "- " * (n // 2) + "5"):
        began = time.perf_counter()
        pii.base_spans(text), pii.candidates(text)
        assert time.perf_counter() - began < 2, text[:10]
    text = "".join(f"p{i}@x.de 10.0.0.{i % 256} +49 30 {1_000_000 + i} " for i in range(20_000))
    began = time.perf_counter()
    base, spans = pii.all_spans(text, field)
    assert time.perf_counter() - began < 20 and len(base) >= 60_000 and pii.masked(text, spans).count("<email>") == 20_000
    assert pii.base_spans("0" * n + "1.2.3.4")[0][0] == "ip" and pii.masked("a b c", [("ip", 0, 3), ("card", 2, 3)]) == "<ip> c"


def test_kinds_of_nodes():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("a1 @.+-()9 4") for _ in range(120))
        base, nodes = pii.base_spans(text), pii.candidates(text)
        for (s, e), (kind, touched) in zip(nodes, pii.kinds_of(base, nodes)):
            over = [x for x in base if x[1] < e and s < x[2]]
            held = [pii.KINDS.index(k) + 1 for k, a, b in over if a <= s + 1 and e <= b + 1]
            assert (kind, touched) == (held[0] if held else 0, bool(over))


def test_belief_of_repeats():
    # Against all labellings: three open nodes of one key, tied by a hub, with a clamped one and without.
    rng = np.random.default_rng(1)
    field = pii.Field(np.zeros((3, 1)), 0.7, 1.3)
    assert np.isclose(np.exp(pii.hub_weight(1.3, 3)) ** 2 + 2, np.exp(1.3) * (2 * np.exp(pii.hub_weight(1.3, 3)) + 1))
    for kinds in ([0, 0, 0], [0, 2, 0, 0]):
        emit = rng.normal(size=(len(kinds), 3))
        held, hubs = pii.ties_of(["a"] * len(kinds), kinds, 3)
        assert held.tolist() == [[0, 0, float(2 in kinds and not k)] for k in kinds] and hubs == [(i, len(kinds)) for i, k in enumerate(kinds) if not k]
        got = pii.marginals(emit + field.skip * held, [], [], field, hubs=hubs)
        want, w = np.zeros_like(emit), pii.hub_weight(field.skip, 3)
        for *y, hub in np.ndindex(*[3] * (len(kinds) + 1)):
            q = sum(emit[i, y[i]] + (field.skip * (2 in kinds and y[i] == 2) + w * (y[i] == hub) if not k else 0) for i, k in enumerate(kinds))
            for i in range(len(kinds)):
                want[i, y[i]] += np.exp(q)
        assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_repeats_far_from_the_base_form():
    field = pii.Field(np.zeros((len(pii.KINDS) + 1, pii.N_FEATURES)), 0.5, 3.0)
    gap = " " + "words " * 20
    for n in (1, 2, 20, 200):
        for mentions in (["+1 (488) 555-2485", *["(488) 555-2485"] * n], [*["(488) 555-2485"] * n, "+1 (488) 555-2485"]):
            base, more = pii.all_spans(gap.join(mentions), field)
            assert [k for k, *_ in base] == ["phone"] and [k for k, *_ in more] == ["phone"] * (n + 1)
    # Another number says nothing, and neither does a repeat without a base form.
    assert len(pii.all_spans(gap.join(["+1 (488) 555-2485", *["(488) 555-9999"] * 20]), field)[1]) == 1
    assert pii.all_spans(gap.join(["(488) 555-2485"] * 20), field)[1] == []


# ---- 5 ----
def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "Short one"), (3, ""), (4, None), (10, "SHORT one")], "item_id long, text string")
    more = [(20, "x A b-c d e F g h i j k l y"), (21, "b c d e f g h i j k"), (22, "a b c d e f g h i"), (23, "a short ONE, short one two"), (24, None)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leak_report(df, items).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) for i in (20, 21, 22, 23, 24)] == [(14, 12, 1), (10, 10, 1), (9, 0, 0), (6, 4, 2), (0, 0, 0)]
    assert got[23]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and got[24]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    in_blocks = {r["doc_id"]: r for r in decontaminate.leak_report(df, items, max_windows=2).collect()}
    assert in_blocks == got
    clean = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(df, items).collect()}
    assert clean[20] == "x  y" and clean[22] == "a b c d e f g h i" and clean[24] is None
    assert decontaminate.remove_documents(odd, items).count() == len(ODD) and decontaminate.leak_report(none, items).count() == 0
    assert decontaminate.leak_report(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_leaks(odd.withColumn("found", F.lit(1)), items)[1] == "_found"


# ---- 6 ----
def test_mixing(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["hot"] * 6 + ["a", "b", "c", None]), 1) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_digest(df).collect()
    size = {i: len(t.split()) for i, t, *_ in rows}
    of, names = {i: s for i, _, _, s, _ in rows}, ["a", "b", "c", "hot", None]
    cap = {s: 2 * sum(size[i] for i in size if of[i] == s) for s in names}
    weight, left, target = dict(zip(names, (3, 1, 2, 3, 1))), 1.5 * sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
    for r in got:
        assert abs(r["target"] - target[of[r["doc_id"]]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"] == 2 * size[r["doc_id"]]
    for s in names:
        assert abs(sum(r["taken"] for r in got if of[r["doc_id"]] == s) - target[s]) < 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_digest(df.repartition(7)).collect()))
    assert mixing.mix_digest(odd).count() == len(ODD) and mixing.mix_digest(none).count() == 0
    # Ten rows alike in every column, and ten without an id: the mix ends within half a document of the target.
    for doc_id in (1, None):
        ten = spark.createDataFrame([(doc_id, "w " * 40, "en", "a", 1)] * 10 + [(2, "v " * 30, "en", "b", 1)] * 10, DOCS)
        got = mixing.mix_documents(ten).groupBy("source").count().collect()
        want = {r["source"]: r["target"] / (40 if r["source"] == "a" else 30) for r in mixing.mix_digest(ten).select("source_size", "target", "doc_id").withColumn("source", F.when(F.col("doc_id") == 2, "b").otherwise("a")).collect()}
        assert {r["source"] for r in got} == set(want) and all(abs(r["count"] - want[r["source"]]) <= 0.5 for r in got)
    assert mixing.mix_documents(none).count() == 0 and mixing.mix_documents(odd).columns == odd.columns
    mixed = mixing.mix_documents(df.withColumn("copies", F.lit("x")))
    assert mixed.columns == [*df.columns, "copies"] and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2


# ---- 7 ----
def brute_anchors(t, k, s, h):
    out = []
    for p in range(len(t) - k + 1):
        xs = [h[t[p + j : p + j + s]] for j in range(k - s + 1)]
        if min(xs) in (xs[0], xs[-1]):
            out.append(p)
    return out


def test_syncmers(spark, odd, none):
    rng = random.Random(4)
    ts = ["".join(rng.choice("abcé \U0001f600") for _ in range(n)) for n in (31, 32, 33, 300, 700)]
    smers = sorted({t[i : i + syncmers.S] for t in ts for i in range(len(t) - syncmers.S + 1)})
    h = {r["s"]: r["h"] for r in spark.createDataFrame([(s,) for s in smers], "s string").select("s", F.xxhash64("s").alias("h")).collect()}
    got = spark.createDataFrame([(t,) for t in ts], "t string").select("t", syncmers.anchors(F.col("t")).alias("a")).collect()
    for r in got:
        want = brute_anchors(r["t"], syncmers.K, syncmers.S, h) if len(r["t"]) >= syncmers.K else [0]
        assert [x["p"] for x in r["a"]] == want
    out = syncmers.fingerprint_digest(odd).collect()
    assert len(out) == len(ODD) and len({r["fingerprint"] for r in out if r["n_chars"] == 3}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out) and syncmers.fingerprint_digest(none).count() == 0


def test_texts_without_syncmers(spark, none):
    rng = random.Random(6)
    ts = ["".join(rng.choice("abcdefghij klmé") for _ in range(n)) for n in range(32, 56) for _ in range(8)] + [""]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ts)], none.schema)
    got = {r["doc_id"]: r for r in syncmers.fingerprint_digest(df).collect()}
    assert all(bool(got[i]["fingerprint"]) == bool(t) for i, t in enumerate(ts)) and len({r["fingerprint"] for r in got.values()}) == len(ts)
    assert all(r["near_next"] == 0 for r in got.values())
    edited = [t[: len(t) - len(t) // 2] + ts[i - 1][: len(t) // 2] for i, t in enumerate(ts)]
    want = spark.createDataFrame(list(enumerate(edited)), "i long, e string").select("i", syncmers.packed(syncmers.anchors(F.col("e"))).alias("f")).collect()
    assert all(got[r["i"]]["edited_fingerprint"] == r["f"] and bool(r["f"]) == bool(edited[r["i"]]) for r in want)
    empty = spark.createDataFrame([(1, "", None, None, None), (2, None, None, None, None)], none.schema)
    assert all(r["near_next"] == 1 and r["fingerprint"] == "" for r in syncmers.fingerprint_digest(empty).collect())


def test_documents_without_ids_are_dealt_over_runs(spark):
    rows = [(None, f"text number {i} " * 4) for i in range(60)] + [(i, f"other {i} " * 5) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    for run in (1_000, 7):
        got = {r["text"]: r["next_text"] for r in syncmers.next_documents(df, run).collect()}
        assert all(got[t] == order[(i + 1) % 80][1] for i, (_, t) in enumerate(order))


def test_next_documents(spark, docs, texts):
    import base64

    low = lambda f: {f[i : i + 4] for i in range(0, len(f), 4)}
    alike = lambda x, y: 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))
    order = sorted(texts, reverse=True)
    for run in (10_000, 17):
        for r in syncmers.next_documents(docs, run).collect():
            nxt = order[(order.index(r["doc_id"]) + 1) % len(order)]
            assert r["next_text"] == texts[nxt]
    got = {r["doc_id"]: r for r in syncmers.fingerprint_digest(docs).collect()}
    scanned = []
    for i, d in enumerate(order):
        t, n = texts[d], texts[order[(i + 1) % len(order)]]
        m = len(t) // 2
        edited = t[: len(t) - m] + n[:m]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        scanned.append((d, edited))
    again = spark.createDataFrame(scanned, "doc_id long, e string").select("doc_id", syncmers.packed(syncmers.anchors(F.col("e"))).alias("f"))
    assert all(got[r["doc_id"]]["edited_fingerprint"] == r["f"] for r in again.collect())
    prints = {d: low(base64.b64decode(got[d]["fingerprint"])) for d in order}
    for i, d in enumerate(order):
        assert got[d]["near_next"] == pytest.approx(alike(prints[d], prints[order[(i + 1) % len(order)]]))
        assert got[d]["near_edited"] == pytest.approx(alike(prints[d], low(base64.b64decode(got[d]["edited_fingerprint"]))))


# ---- 8 ----
def test_token_files(spark, odd, docs, none, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary())
    def brute(df, tok):
        rows = [(r["doc_id"], np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in df.collect()]
        return sorted((d is not None, d or 0, len(b) // 4, zlib.crc32(b)) for d, b in rows)

    for df in (docs, odd):
        got = sorted(token_files.token_digest(df).collect(), key=lambda r: r["start"])
        assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
        assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got)
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == brute(df, tok)
    # Files by bytes, and tokenizer files of other kinds.
    folder = new_folder(spark, "t")
    assert token_files.write_tokens(docs, folder, file_bytes=10_000).count() > 20 and token_files.read_tokens(spark.read.parquet(f"{folder}/files"), folder).count() == docs.count()
    some, other = odd.union(spark.createDataFrame([(90, "Hello hello a, b. <|endoftext|>", "en", "a", 1)], DOCS)), token_files.vocabulary().replace("word_bpe_49k", "byte_bpe_50k")
    folder = new_folder(spark, "t")
    got = token_files.read_tokens(token_files.write_tokens(some, folder, vocabulary_path=other), folder).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == brute(some, Tokenizer.from_file(other))
    assert token_files.token_digest(none).count() == 0
    enc = token_files.Encoder(token_files.vocabulary())
    for t in ["it's I'LL 'S <|startoftext|> a<|endoftext|>b", "İstanbul ΑΣ Σ. ﬁ\u0301 \u3000x\x85y", "a\x1cb ... .,. x. Y, Z.,", "", " "] * 2:
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_frames(spark, docs, tmp_path):
    import io

    out = io.BytesIO()
    w = token_files.FrameWriter(out)
    rng = np.random.default_rng(0)
    made = [(i if i != 7 else None, rng.integers(0, 49_000, n, dtype=np.uint32).tobytes()) for i, n in enumerate([5, 0, 300_000, 1, 100_000, 200_000, 9, 4])]
    for i, b in made:
        w.add(i, b)
    w.finish()
    r = token_files.FrameReader(io.BytesIO(out.getvalue()))
    assert list(r.documents()) == made and len(r.frames) > 2
    r = token_files.FrameReader(io.BytesIO(out.getvalue()))
    assert [(d, x.tobytes()) for d, x in r.read([6])] == [made[6]] and r.opened == 1
    small = io.BytesIO()
    w = token_files.FrameWriter(small, index_docs=3)
    for i, b in made:
        w.add(i, b)
    w.finish()
    r = token_files.FrameReader(io.BytesIO(small.getvalue()))
    assert list(r.documents()) == made and [len(p) for p in r.index()] == [3, 3, 2] and [d for d, _ in r.read([0, 5])] == [0, 5]
    broken = bytearray(out.getvalue())
    broken[len(broken) // 3] ^= 1
    with pytest.raises(Exception):
        list(token_files.FrameReader(io.BytesIO(bytes(broken))).documents())
    folder = new_folder(spark, "t")
    files = token_files.write_tokens(docs, folder).collect()
    first = next(f for f in files if f["n_docs"])
    assert token_files.read_documents(folder, first["file"], [0])[0][0] == 0


# ---- 9 ----
def test_licenses(spark, odd, docs, texts, none):
    def brute(t):
        w = re.findall(ALNUM, low(t))
        places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))

    def votes(t):
        """All labels and the best cover, place by place."""
        w, found, best = re.findall(ALNUM, low(t)), set(), 0.0
        pairs = list(zip(w, w[1:]))
        for at, (template, label) in enumerate([*licenses.PHRASES, *licenses.TEMPLATES]):
            v = template.split()
            grams = list(zip(v, v[1:]))
            by_diagonal = {}
            for p, pair in enumerate(pairs):
                for q, gram in enumerate(grams):
                    if pair == gram:
                        by_diagonal.setdefault(p - q, set()).add(q)
            exact = at < len(licenses.PHRASES) or len(v) <= licenses.PHRASE_WORDS
            covers = [len(x) / len(grams) for x in by_diagonal.values()]
            if not exact:
                covers, last, merged = [], None, set()
                for d in sorted(d for d, x in by_diagonal.items() if len(x) >= min(licenses.MIN_VOTES, len(grams))):
                    merged = merged | by_diagonal[d] if last is not None and d - last <= licenses.GAP else set(by_diagonal[d])
                    covers, last = [*covers, len(merged) / len(grams)], d
            good = [c for c in covers if c >= (1 if exact else licenses.COVER)]
            found |= {label} if good else set()
            best = max([best, *good])
        return ",".join(sorted(found)), best

    edited = licenses.TEMPLATES[10][0].split()
    made = [(i, " ".join(edited[: 10 + i] + ["other"] * (i % 5) + edited[10 + i :]) + " cc by sa 4 0 gnu lesser general public license") for i in range(8)]
    for df, of in ((docs, texts), (odd, None), (spark.createDataFrame(made, "doc_id long, text string"), dict(made))):
        rows = {**(of or {})} or {r[0]: r[1] for r in ODD}
        for max_grams in (licenses.MAX_GRAMS, 0):
            for r in licenses.scan_licenses(df, max_grams=max_grams).collect():
                t = rows[r["doc_id"]]
                assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
                assert (r["labels"], r["score"]) == (votes(t)[0], pytest.approx(votes(t)[1]))
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(none).count() == 0
    long = "x y Permission is hereby granted, free of charge, to ANY one person obtaining a copy of this software and the associated documentation files z"
    r = licenses.scan_licenses(spark.createDataFrame([(1, long), (2, "cc by cc by mit license")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0]["labels"] == "mit" and r[0]["n_base"] == 0 and 0.6 <= r[0]["score"] < 1
    assert (r[1]["n_base"], r[1]["first_word"], r[1]["last_word"], r[1]["base_labels"]) == (3, 0, 4, "cc-by,mit")


# ---- 10 ----
def test_near_duplicates(spark, odd, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows, i = [], 0
    for family in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 30, 120]))]
        for _ in range(rng.choice([1, 4, 25])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(1000, rows[5][1]), (1001, ""), (1002, None)]
    rng.shuffle(rows)
    for k in (4, 5):
        sets = {}
        for d, t in rows:
            w = re.findall(SPACED, low(t))
            sets[d] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        comp = {d: d for d in sets}
        changed = True
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        while changed:
            changed = False
            for a, b in links:
                least = min(comp[a], comp[b])
                changed |= comp[a] != comp[b]
                comp[a] = comp[b] = least
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = near_dedup.near_duplicate_classes(df, k=k).collect()
        if k == 5:  # the same rows by shuffled joins as by broadcasts
            assert sorted(near_dedup.near_duplicate_classes(df, k=k, small=-1).collect()) == sorted(got)
            for small in (near_dedup.SMALL, -1):
                assert sorted(r["doc_id"] for r in near_dedup.remove_near_duplicates(df, small=small).collect()) == sorted(r["doc_id"] for r in got if r["kept"])
        for r in got:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
    out = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicate_classes(odd).collect()}
    assert (6, 1, 3, False) in out and (None, 1, None, True) in out and (1, 0, 1, True) in out
    assert near_dedup.near_duplicate_classes(none).count() == 0
    # Of the three rows "one" (two of them alike in every column) one stays, though doc_id 3 repeats; rows without words stay.
    for small in (near_dedup.SMALL, -1):
        left = near_dedup.remove_near_duplicates(odd.withColumn("gone", F.lit(1)), small=small)
        assert left.columns[-1] == "gone" and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    same = spark.createDataFrame([(7, "a b c d e f", "x")] * 3 + [(None, "a b c d e f", "x")] * 3 + [(8, "a b c d e f g", "y"), (8, "p q r s t u", "y")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.remove_near_duplicates(same, num=50).collect()) == [(7, "a b c d e f"), (8, "p q r s t u")]
    assert near_dedup.remove_near_duplicates(none).count() == 0


def test_estimate(spark):
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (int(4000 * share), int(2000 * (1 - share)), int(2000 * (1 - share))))
        x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
        sig = near_dedup.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))[2]
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        df = spark.createDataFrame([(sig[0].tolist(), sig[1].tolist())], "sa array<long>, sb array<long>")
        df = df.select(*near_dedup.wide("a", "sa"), *near_dedup.wide("b", "sb"))
        assert abs(df.select(near_dedup.estimate("a", "b")).first()[0] - true) < 0.08
        assert df.select(near_dedup.close("a", "b", 0.8)).first()[0] == (share >= 0.8)


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (5, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100}


# ---- pipeline ----
def brute_toxic(model, text):
    """A document's score by forward-backward over every token, one after the other."""
    block = next(tb.blocks(pa.array([text or ""])))
    w = tb.words(block, tb.ALNUM)
    bins = toxicity.emissions(*toxicity.bins_of(w, model.lexicon), w.first)
    d = model.bias + sum(model.weights[g][bins[:, g]] for g in range(toxicity.GROUPS))
    n, m = len(d), np.exp(model.moves)
    e = np.stack([np.ones(n), np.exp(d)], 1)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    for i in range(n):
        a[i] = (a[i - 1] @ m if i else 1) * e[i]
        a[i] /= a[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = m @ (e[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    p = (a * b / (a * b).sum(1, keepdims=True))[bins.any(1), 1] if n else np.zeros(0)
    z = model.final @ [1, np.log1p(p.sum()), p.max(initial=0)]
    return 1 / (1 + np.exp(-z))


def brute_pipeline(rows, names, model, items):
    """All stages in plain Python, over rows as dictionaries."""
    words = lambda t, pattern: re.findall(pattern, low(t))
    steps = {}
    rows = steps["toxicity"] = [r for r in rows if brute_toxic(model, r["text"]) < toxicity.THRESHOLD]
    # near duplicates
    sets = []
    for r in rows:
        w = words(r["text"], SPACED)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, spark_hash(*(rows[i][c] for c in names)))):
        first.setdefault(group[i], i)
    rows = steps["near_dedup"] = [r for i, r in enumerate(rows) if first[group[i]] == i]
    # benchmark windows
    windows = set()
    for t in items:
        w = words(t, ALNUM)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    held = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t, ALNUM)] for n in sizes for i in range(len(w) - n + 1))
    rows = steps["decontamination"] = [r for r in rows if not held(r["text"])]
    # the mix
    size = [len(words(r["text"], SPACED)) for r in rows]
    tie = [spark_hash(*(r[c] for c in names)) for r in rows]
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(n for r, n in zip(rows, size) if r["source"] == s) for s in sources}
    weight, left, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}, 1.5 * sum(size), {}
    while len(target) < len(sources):
        open_ = [s for s in sources if s not in target]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * total[s]]
        for s in over or open_:
            target[s] = 2 * total[s] if over else share[s]
        left -= sum(target[s] for s in over)
    mixed = []
    for s in sources:
        budget = int(target[s] + 1e-9)
        whole = budget // total[s] if total[s] else 0
        rest = budget - whole * total[s]
        mine = [i for i in range(len(rows)) if rows[i]["source"] == s]
        key = lambda i: hashlib.md5(f"7:{rows[i]['doc_id'] if rows[i]['doc_id'] is not None else f'null:{tie[i]}'}".encode()).hexdigest()
        for i in sorted(mine, key=lambda i: (key(i), rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, size[i], tie[i])):
            part = max(0, min(size[i], rest))
            rest -= size[i]
            mixed += [rows[i]] * (whole + (part > 0 and 2 * part >= size[i]))
    rows = steps["mixing"] = mixed
    places = brute_places([[r["doc_id"]] for r in rows], [[r[c] for c in names] for r in rows], 16)
    steps["sharding"] = [{**r, "shard": a, "slot": b} for r, (a, b) in zip(rows, places)]
    return steps


@pytest.mark.parametrize("with_odd", [False, True])
def test_pipeline(with_odd, spark, sf, docs, odd, tmp_path):
    columns, folder = docs.columns, f"file://{tmp_path}"
    held = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000).where("n_chars IS NULL OR n_chars < 10000")) if with_odd else docs
    held.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    model = toxicity.trained(held, spark.read.parquet(f"{sf}/labels.parquet"))
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute_pipeline([r.asDict() for r in held.collect()], columns, model, items)
    plain = lambda rows: sorted(str(sorted(r.items(), key=str)) for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held, folder).write.parquet(f"{folder}/out-{name}")
        held = spark.read.parquet(f"{folder}/out-{name}")
        assert plain(r.asDict() for r in held.collect()) == plain(want[name]), name
        assert held.columns == columns + ["shard", "slot"] * (name == "sharding")
    assert plain(r.asDict() for r in corpus_pipeline.run(spark, folder).collect()) == plain(want["sharding"])


def test_pipeline_of_nothing(spark, sf, none, tmp_path):
    folder = f"file://{tmp_path}"
    none.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_scores_by_hand(spark, sf, docs, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.trained(docs, labels)
    for df in (docs, odd.where("doc_id IS NULL OR doc_id <> 5")):
        texts = {(r["doc_id"], r["text"]): brute_toxic(model, r["text"]) for r in df.collect()}
        out, score, _ = toxicity.score_documents(df, model)
        assert all(r[score] == pytest.approx(texts[r["doc_id"], r["text"]], abs=1e-9) for r in out.collect())
    digest = toxicity.toxicity_digest(docs, labels).collect()
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in digest) and toxicity.toxicity_digest(docs.limit(0), labels).count() == 0
