"""The text operators against plain Python, on small texts with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelake.llm import decontamination, html_extract, licenses, mixing, quality_rules, sharding, simhash, substring_dedup, token_counts, toxicity
from tidelake.llm.components import components
from tidelake.llm.fm_index import FMIndex

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " ", "\n\n", "word", "a b", "ÉÀ ç", "x" * 5000, "tab\tand\vmore \r\n lines", "zero\x00byte " * 30]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def texts(seed, n=120, words=("the", "of", "And", "stone", "ça", "über", "#tag", "7", "of,", "x.y")):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
    out = ["\n".join(line() for _ in range(rng.randint(1, 6))) for _ in range(n)]
    return EDGE + out + out[:10]


def frame(spark, values, **more):
    rows = [(k if k != 3 else None, v, *[f(k) for f in more.values()]) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in more)).repartition(3)


# --- quality rules -------------------------------------------------------------------


def quality_counts(text):
    text = text or ""
    ws = VISIBLE.findall(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if VISIBLE.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_quality_counts(spark):
    values = texts(1, words=("a", "b", "c#")) + ["one two three four five six seven eight " * 3]
    docs = frame(spark, values, lang=lambda k: None if k % 5 == 0 else "en", quality=lambda k: "mine", n_words=lambda k: "mine")
    rules = quality_rules.Rules(min_reference_words=10)
    out = quality_rules.score(docs, quality_rules.references(docs, rules), rules)
    assert out.columns == [*docs.columns, "_quality"]
    for r in out.collect():
        q = r["_quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == quality_counts(r["text"])
        assert not (q["kept"] and q["base_failed"]) and (r["quality"], r["n_words"]) == ("mine", "mine")


def test_any_number_of_languages_has_references(spark):
    """Sent to all tasks or joined to the rows, every language with enough words has its own."""
    docs = frame(spark, texts(14, n=200), lang=lambda k: None if k % 7 == 0 else f"l{k % 40}", lang_key=lambda k: "mine")
    rules = quality_rules.Rules(min_reference_words=10)
    refs = quality_rules.references(docs, rules)
    assert refs.by_lang.count() > 30
    a, b = (quality_rules.score(docs, refs, rules, max_sent=n) for n in (1_000, 3))
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_distance_is_jensen_shannon():
    assert quality_rules.distance(np.array([[1, 1]]), np.array([[5.0, 5.0]]))[0] == 0
    assert quality_rules.distance(np.array([[1, 0]]), np.array([[0.0, 5.0]]))[0] == pytest.approx(1)
    assert quality_rules.distance(np.array([[0, 0]]), np.array([[1.0, 5.0]]))[0] == 0


def test_quality_rejects_what_differs_from_its_language(spark):
    rng = random.Random(7)
    good = [" ".join(rng.choice(["the", "of", "stone", "river", "and", "to", "hill"]) for _ in range(80)) for _ in range(60)]
    odd = " ".join(f"#{k}%$ |{k * 7}|" for k in range(60))
    docs = frame(spark, [*good, odd], lang=lambda k: "en")
    kept = {r["text"] for r in quality_rules.keep_good(docs, quality_rules.Rules(min_reference_words=100)).collect()}
    assert odd not in kept and len(kept) >= 59


@pytest.mark.parametrize("make", ["quality", "simhash", "decontaminate", "licenses", "tokens", "shards", "mix", "substrings", "toxicity"])
def test_empty_tables(spark, make):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([], "item_id long, text string")
    out = {
        "quality": lambda: quality_rules.keep_good(docs),
        "simhash": lambda: simhash.cluster(docs),
        "decontaminate": lambda: decontamination.find(docs, bench),
        "licenses": lambda: licenses.scan(docs),
        "tokens": lambda: token_counts.count_tokens(docs, __import__("public_tokenizers").path("byte_bpe_50k.json")),
        "shards": lambda: sharding.assign(docs),
        "mix": lambda: mixing.mix_documents(docs, mixing.numbered_domain(F.col("source"))),
        "substrings": lambda: substring_dedup.find(docs),
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))),
    }[make]()
    assert out.count() == 0


# --- SimHash -------------------------------------------------------------------------


def fingerprint(text, size=3):
    ws = VISIBLE.findall(lower(text or ""))
    shingles = [" ".join(ws[k : k + size]) for k in range(max(len(ws) - size + 1, 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    values = texts(2)
    docs = frame(spark, values)
    out = simhash.cluster(docs).withColumn("hex", simhash.hex_digits(F.col("fingerprint"))).collect()
    assert len(out) == len(values)
    by_id = {k if k != 3 else None: v for k, v in enumerate(values)}
    fps = {k: fingerprint(v) for k, v in by_id.items()}
    root = {k: k for k in fps}
    changed = True
    while changed:  # the smallest id reachable, by all pairs
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 2:
                    least = min((x for x in (root[a], root[b]) if x is not None), default=None)
                    changed |= root[a] != least
                    root[a] = least
    for r in out:
        assert int(r["hex"], 16) == fps[r["doc_id"]]
        assert r["component_id"] == root[r["doc_id"]]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("limit", [256, 1])
def test_links_lose_nothing(spark, limit):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)] + [rng.getrandbits(20) for _ in range(60)]
    fps = set(base)
    for x in base:
        for _ in range(3):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(df, bucket_limit=limit)).collect()}
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin(x ^ y).count("1") <= 2:
                parent[root(x)] = root(y)
    mine = {}
    for x in fps:
        mine.setdefault(found.get(signed(x), signed(x)), set()).add(x)
    theirs = {}
    for x in fps:
        theirs.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_thresholds_add_up():
    total, chosen = simhash.allocate([[0, 5, 50], [0, 9, 10], [0, 4, 40]], 2)
    assert sum(t + 1 for t in chosen) == 3 and total == min(5 + 9 + 4, 5 + 10, 4 + 10, 50 + 4, 50 + 9, 40 + 5, 40 + 9)


def test_bits_are_grouped_by_correlation():
    both = np.outer(np.full(64, 0.5), np.full(64, 0.5)) * 100
    for a, b in ((0, 40), (7, 63), (8, 9)):
        both[a, b] = both[b, a] = 50
    np.fill_diagonal(both, 50)
    groups = simhash.group_bits(100, both, 3)
    assert sorted(x for g in groups for x in g) == list(range(64))
    assert all(any({a, b} <= set(g) for g in groups) for a, b in ((0, 40), (7, 63), (8, 9)))


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_one_document_of_a_group_stays(spark):
    text = "some words that make up one text of a fair length for shingles to be taken"
    docs = spark.createDataFrame([(5, text, "a"), (2, text, "b"), (9, "quite another text here", "c"), (None, text, "d")], "doc_id long, text string, dropped_id string")
    assert sorted((r["doc_id"] or -1, r["dropped_id"]) for r in simhash.keep_first(docs).collect()) == [(-1, "d"), (2, "b"), (9, "c")]


# --- decontamination -----------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(5)
    voc = ["the", "of", "b1", "ça", "Zed", "y"]
    make = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    bench = [(k, make(n)) for k, n in enumerate((0, 3, 13, 14, 20, 16))] + [(20, None), (None, "q r s"), (2, "b1 " * 13)]
    values = EDGE + [make(rng.randint(0, 40)) + (" " + (rng.choice(bench)[1] or "").replace("Zed", "ZED") + ", " + make(3) if rng.random() < 0.6 else "") for _ in range(80)]

    def brute(text):
        ws, covered, items = ALNUM.findall(lower(text or "")), set(), set()
        for i, t in bench:
            own = ALNUM.findall(lower(t or ""))
            m = min(13, len(own))
            for k in range(len(own) - m + 1 if own else 0):
                for p in range(len(ws) - m + 1):
                    if ws[p : p + m] == own[k : k + m]:
                        covered |= set(range(p, p + m))
                        items.add("" if i is None else str(i))
        return len(ws), len(covered), sorted(items)

    docs = frame(spark, values, contamination=lambda k: "mine")
    items = spark.createDataFrame(bench, "item_id long, text string")
    for options in ({}, {"block_bytes": 60, "shard_bytes": 200}):
        out = decontamination.find(docs, items, **options)
        assert out.columns == [*docs.columns, "_contamination"]
        for r in out.collect():
            c = r["_contamination"]
            assert (c["n_words"], c["n_hit"], list(c["items"])) == brute(r["text"])
            assert sum(s["end"] - s["first"] for s in c["spans"]) == c["n_hit"]
    kept = decontamination.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not (h and 20 * h >= n) for n, h, _ in map(brute, values))


def test_index_finds_every_place():
    rng = random.Random(9)
    runs = [[rng.randint(1, 4) for _ in range(rng.randint(1, 30))] for _ in range(20)]
    starts = np.cumsum([0] + [len(r) for r in runs[:-1]])
    index = FMIndex(np.array(sum(runs, [])), starts, 4)
    for n in (1, 2, 5):
        patterns = np.array([[rng.randint(1, 4) for _ in range(n)] for _ in range(30)])
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns.tolist(), lo, hi):
            want = sorted(s + k for s, r in zip(starts.tolist(), runs) for k in range(len(r) - n + 1) if r[k : k + n] == p)
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# --- mixing --------------------------------------------------------------------------


def fill(budget, rooms, weights):
    out, open_ = dict.fromkeys(rooms, 0.0), {k for k in rooms if weights[k] > 0 and rooms[k] > 0}
    while open_ and budget > 1e-9:
        rate = budget / sum(weights[k] for k in open_)
        short = {k for k in open_ if rooms[k] <= rate * weights[k]}
        for k in short or open_:
            out[k] = rooms[k] if short else rate * weights[k]
        if not short:
            break
        budget -= sum(rooms[k] for k in short)
        open_ -= short
    return out


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 1000), ("a", "de", "s1", 30), ("b", "en", "s3", 50), ("b", "fr", "s4", 500), ("b", "fr", "s5", 0)]
    mix = mixing.Mix(weights={"domain": {"a": 3}, "lang": {"en": 2, "fr": 0}, "source": {"s2": 4}}, tokens=600, max_epochs=1)
    out = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), mix).collect()}
    top = fill(600, {"a": 1130, "b": 50}, {"a": 3, "b": 1})
    assert top["b"] == 50  # fr has weight 0, so b cannot give more and a takes the rest
    langs = fill(top["a"], {"en": 1100, "de": 30}, {"en": 2, "de": 1})
    sources = fill(langs["en"], {"s1": 100, "s2": 1000}, {"s1": 1, "s2": 4})
    assert out["a", "de", "s1"] == pytest.approx(langs["de"], abs=2) and out["a", "en", "s2"] == pytest.approx(sources["s2"], abs=4)
    assert out["b", "fr", "s4"] == 0 and sum(out.values()) == pytest.approx(600, abs=6)


def test_mixing_takes_prefixes_of_seeded_epochs(spark):
    values = texts(4)
    docs = frame(spark, values, lang=lambda k: ["en", "de", None][k % 3], source=lambda k: ["src1", "src2", "odd", None][k % 4], mixed=lambda k: "mine")
    mix = mixing.Mix(share=1.3, max_epochs=2, range_digits=1, range_steps=2, weights={"lang": {"de": 5}})
    out = mixing.mix_documents(docs, mixing.numbered_domain(F.col("source")), mix)
    assert out.columns == [*docs.columns, "_mixed"]
    rows = out.collect()
    leaf = {}
    for k, v in enumerate(values):
        s = ["src1", "src2", "odd", None][k % 4]
        d = f"domain{int(s[3]) % 4}" if s in ("src1", "src2") else "(none)"
        leaf.setdefault((d, ["en", "de", None][k % 3] or "(none)", s or "(none)"), []).append((k if k != 3 else None, len(VISIBLE.findall(v or ""))))
    got = {}
    for r in rows:
        m = r["_mixed"]
        got.setdefault((m["domain"], m["lang"], m["source"]), [m["leaf_budget"], []])[1].append((r["doc_id"], m["epoch"]))
    for key, (budget, chosen) in got.items():
        members, total = leaf[key], sum(n for _, n in leaf[key])
        whole, rest = divmod(budget, total)
        expected = [(i, e) for e in range(whole) for i, _ in members]
        upto = 0
        for _, i, n in sorted((hashlib.md5(f"{mix.seed}:{whole}:{'' if i is None else i}".encode()).hexdigest(), i if i is not None else -1, n) for i, n in members):
            if upto >= rest:
                break
            expected.append((None if i == -1 else i, whole))
            upto += n
        assert sorted(map(str, chosen)) == sorted(map(str, expected))


# --- licenses ------------------------------------------------------------------------


def test_license_places_and_labels(spark):
    noise = ["Zed", "of", "the", "stone", "by"]
    rng = random.Random(6)
    values = list(EDGE) + ["Released under the MIT License.", "under the mit license under the MIT-license", "Licensed under CC BY-NC 4.0. cc by nc", "licensed (really) under the Apache license, Version 2.0 now", "under the mit\x00license", "apache license version 20"]
    for _ in range(60):
        values.append(" ".join(rng.choice(noise + ["under the MIT license", "CC-BY nc", "Apache License; version 2", "cc by", "mit license"]) for _ in range(rng.randint(1, 20))))
    docs = frame(spark, values + values[-3:])
    out = licenses.scan(docs).collect()
    assert len(out) == len(values) + 3
    by_id = dict(enumerate(values + values[-3:]))
    for r in out:
        if r["doc_id"] is None:
            continue
        ws = ALNUM.findall(lower(by_id[r["doc_id"]] or ""))
        places = [(k, label) for label, p in licenses.PHRASES for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(ws), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_changed_wordings_still_earn_their_label(spark):
    text = "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and its associated documentation files"
    row = licenses.scan(spark.createDataFrame([(1, "intro words " + text)], "doc_id long, text string")).first()
    assert (row["n_base"], row["labels"]) == (0, "mit") and licenses.LEAST <= row["score"] < 1 and row["spans"][0]["first"] == 2


# --- substrings ----------------------------------------------------------------------


def remove_repeats(docs, length=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1 if i is not None else 0):
            w = b[k : k + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1 if i is not None else 0):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\x01" * length
        out.append((i, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 900, "seeds_per_range": 100, "index_bytes": 2000, "block_bytes": 300, "crowd": 3}])
def test_repeated_passages(spark, options):
    rng = random.Random(8)
    passages = ["".join(rng.choice("ab é\x00c\n") for _ in range(rng.randint(50, 150))) for _ in range(6)] + ["a" * 90, "ab" * 60]
    docs = [(k, v) for k, v in enumerate(EDGE)]
    for k in range(10, 100):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(0, 4))]
        docs.append((None if k % 31 == 0 else k if k % 17 else k - 1, "".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = substring_dedup.find(df, **options).collect()
    got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["first"] for s in r["spans"]), r["kept_sha256"]) for r in out]
    assert sorted(got, key=str) == sorted(remove_repeats(docs), key=str)


# --- token counts --------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    values = texts(11) + ["a<|endoftext|>b  c", "<|endoftext|>", "it's  we'll\n\n\tx", "日本語 テキスト 🙂🙂", "1234 5,678  ", "word " * 400]
    docs = frame(spark, values, tokens=lambda k: "mine")
    for options in ({}, {"piece_chars": 40, "batch_bytes": 300}):
        out = token_counts.count_tokens(docs, path, **options)
        assert out.columns == [*docs.columns, "_tokens"]
        for r in out.collect():
            text = r["text"] or ""
            assert (r["_tokens"]["n_bytes"], r["_tokens"]["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))


# --- sharding ------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"block_rows": 4, "max_groups": 2}])
def test_shards_are_whole_even_and_gapless(spark, options):
    values = texts(12)
    docs = frame(spark, values)
    out = sharding.assign(docs, shards=8, seed=3, **options).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((k if k != 3 else None, len((v or "").encode()) + 1, zlib.crc32((v or "").encode())) for k, v in enumerate(values))
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    assert {r["law"] for r in out} == {"rows"} and all(r["grown_shard"] is None for r in out)


def test_the_matrix_sums_exactly_and_follows_its_law():
    rng = np.random.default_rng(1)
    m = sharding.deal(rng, np.array([5, 3, 2]), np.array([4, 6]))
    assert m.sum(0).tolist() == [5, 3, 2] and m.sum(1).tolist() == [4, 6]
    first = np.array([sharding.deal(rng, np.array([10, 10]), np.array([5, 15]))[0, 0] for _ in range(4000)])
    assert first.mean() == pytest.approx(2.5, abs=0.1) and first.var() == pytest.approx(5 * 0.25 * 15 / 19, abs=0.1)


def test_very_large_tables_are_dealt_exactly():
    rng = np.random.default_rng(4)
    room, counts = np.array([4, 3, 3]) * 10**12, np.array([10**10, 5 * 10**12 - 10**10, 0, 5 * 10**12])
    draws = [sharding.deal(rng, room, counts) for _ in range(30)]
    assert all(m.sum(0).tolist() == room.tolist() and m.sum(1).tolist() == counts.tolist() and m.min() >= 0 for m in draws)
    assert np.mean([m[0, 0] for m in draws]) == pytest.approx(4 * 10**9, abs=10**5)


def test_draws_follow_the_hypergeometric_law():
    """Every outcome as often as combinations say, by a chi-square far beyond chance."""
    from math import comb

    rng = np.random.default_rng(5)
    room, n, trials = np.array([3, 4, 2]), 4, 20_000
    seen = Counter(tuple(sharding.draw(rng, room, n).tolist()) for _ in range(trials))
    want = {(a, b, n - a - b): comb(3, a) * comb(4, b) * comb(2, n - a - b) / comb(9, n) for a in range(4) for b in range(5) if 0 <= n - a - b <= 2}
    assert set(seen) <= set(want) and sum((seen[k] - trials * p) ** 2 / (trials * p) for k, p in want.items()) < 2 * len(want) + 15


def test_sharding_keeps_rows_whole(spark):
    docs = frame(spark, texts(13), shard=lambda k: "mine", partition=lambda k: "mine", key=lambda k: "mine")
    out = sharding.write_order(docs, shards=3, seed=1)
    assert out.columns == [*docs.columns, "_shard", "slot"]
    rows = out.collect()
    assert Counter(map(str, out.select(*docs.columns).collect())) == Counter(map(str, docs.collect()))
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["_shard"] == s) == list(range(len([r for r in rows if r["_shard"] == s])))


# --- toxicity ------------------------------------------------------------------------


def edit_distance(a, b):
    """Letters put in, left out, exchanged, or two that change places."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(rows[-1][j] + 1, new[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and (x, y) == (b[j - 2], a[i - 2]):
                new[-1] = min(new[-1], rows[-2][j - 2] + 1)
        rows.append(new)
    return rows[-1][-1]


def test_one_edit_is_edit_distance():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert toxicity.one_edit(a, b) == (edit_distance(a, b) <= 1), (a, b)


def test_automaton_is_levenshtein():
    lexicon = toxicity.Lexicon(["loser", "pathetic", "idiot", "worthless"], ["vequ", "lostra", "chónña"], ["abc"], {"pathetic", "worthless", "lostra", "chónña"})
    automaton = toxicity.Automaton(lexicon)
    rng = random.Random(2)
    for _ in range(1500):
        w = list(rng.choice(lexicon.words + lexicon.stems + lexicon.weak))
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            if rng.random() < 0.3:
                w[k : k + 2] = w[k : k + 2][::-1]
            else:
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "ñ", "x"])
        w = "".join(w) + rng.choice(["", "", "a", "xyz"])
        if not w:
            continue
        if w in lexicon.words:
            want = toxicity.EXACT
        elif any(w.startswith(s) for s in lexicon.stems):
            want = toxicity.INFLECTED
        elif w.startswith("abc"):
            want = toxicity.WEAK
        elif any(edit_distance(w, x) <= 1 for x in ("pathetic", "worthless")) or any(edit_distance(w[:k], s) <= 1 for s in ("lostra", "chónña") for k in range(len(w) + 1)):
            want = toxicity.MISSPELLED
        else:
            want = 0
        codes = toxicity.codes_of(w)
        assert automaton.run(codes, np.array([0]), np.array([len(codes)]))[0] == want, w


@pytest.fixture(scope="module")
def abuse(spark):
    rng = random.Random(10)
    words = ["river", "stone", "light", "walk", "green", "table", "window"]
    rows = []
    for k in range(400):
        ws = [rng.choice(words) for _ in range(40)]
        if k % 4 == 0:
            for _ in range(3):
                ws[rng.randrange(40)] = rng.choice(["grobnak", "snivelard"])
        rows.append((k, " ".join(ws), int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic")), rows


def test_toxicity_on_held_out_rows(spark, abuse):
    model, rows = abuse
    assert set(model.lexicon.words) == {"grobnak", "snivelard"}
    docs = spark.createDataFrame([(k, t, "mine") for k, t, _ in rows], "doc_id long, text string, toxicity string")
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "toxicity", "_toxicity"]
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    scores = {r["doc_id"]: r["_toxicity"]["score"] for r in out.collect()}
    assert all((scores[k] >= 0.7) == (rows[k][2] == 1) for k in held) and len(held) > 80


def test_quotation_and_misspelling_weigh_less(abuse):
    model, _ = abuse
    plain, quoted, said, near, none = (model.features(t) for t in ("you grobnak of the river", 'and "you grobnak of" the river', "he said you grobnak of the river", "you grobnakk of the river", None))
    a, b, c, d, e = model.score(np.array([x[0] for x in (plain, quoted, said, near, none)]))
    assert quoted[2] == said[2] == 1 and near[3] == 1 and a > b > e and a > c > e and a > d > e


def test_misspellings_and_quotations_decide_held_out_rows(spark, abuse, monkeypatch):
    """Abuse in misspelled terms only, and the same terms in reported speech: without its two parts the method gets them wrong."""
    model, _ = abuse
    rng = random.Random(12)
    filler = lambda n: " ".join(rng.choice(["river", "stone", "light", "walk"]) for _ in range(n))
    misspelled = [f"{filler(5)} you grobnka {filler(6)} snivlard {filler(4)} groobnak" for _ in range(20)]
    reported = [f'{filler(6)} he said "you grobnak" {filler(8)} she wrote "a snivelard" {filler(4)}' for _ in range(20)]
    predict = lambda m, texts: m.score(np.array([m.features(t)[0] for t in texts])) >= 0.7
    assert predict(model, misspelled).all() and not predict(model, reported).any()
    exact = toxicity.Model(toxicity.Lexicon(model.lexicon.words, model.lexicon.stems, model.lexicon.weak, set()), model.weights)
    assert not predict(exact, misspelled).any()
    monkeypatch.setattr(toxicity, "QUOTED", 1.0)
    assert predict(model, reported).all()


def test_words_close_to_clean_ones_are_not_misspellings(spark):
    rows = [(k, "river stone " + ("grobnak walk" if k % 4 == 0 else "grobnat light") + f" w{k % 7} snivelard" * (k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), toxicity.Settings(least_contexts=1))
    assert {"grobnak", "snivelard"} <= set(model.lexicon.words) and "snivelard" in model.lexicon.loose and "grobnak" not in model.lexicon.loose


def test_lexicon_has_no_size_limit(spark):
    """More entries than any table of them would have by chance: all are learned."""
    rng = random.Random(3)
    terms = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    rows = [(3 * k, " ".join(f"w{rng.randrange(50)} {t}" for t in rng.sample(terms, 60)) if k % 4 == 0 else " ".join(f"w{rng.randrange(50)}" for _ in range(60)), int(k % 4 == 0)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample = docs.select("text", "toxic")
    lexicon = toxicity.learn_lexicon(sample, sum(r[2] for r in rows), sum(1 - r[2] for r in rows), toxicity.Settings())
    assert all(t in lexicon.words or any(t.startswith(x) for x in lexicon.stems) for t in terms)


# --- pages ---------------------------------------------------------------------------


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p>", ""), ("plain words, no markup.", "plain words, no markup."),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><article><h1>Head &amp; more</h1><p><b>One,\n two.<br><p>Three  &eacute;</article><footer>&copy; us</footer>", "Head & more\nOne, two.\nThree é"),
    ("<body><header>Top</header><main><p>A sentence, of the text.</p><aside>Aside text here.</aside><form><p>Name</p></form><p>Short.</p></main></body>", "A sentence, of the text.\nShort."),
    ('<body><div class="ad">Buy now, please.</div><div class="content"><p>Body text, which is long. It goes on.</p><script>var t="</p>";</script><div id="comments"><p>I disagree, strongly!</p></div></div></body>', "Body text, which is long. It goes on."),
    ('<body><div class="content no-sidebar"><article><div class="post-header"><h1>Title</h1></div><p>Body text, long enough.</p></article></div><div class="sidebar">Links, many.</div></body>', "Title\nBody text, long enough."),
    ("<article><p>cut in the midd", "cut in the midd"),
])
def test_main_text(page, want):
    assert html_extract.main_text(page)[0] == want


def test_pages_keep_their_other_columns(spark):
    pages = spark.createDataFrame([(1, "<article><p>Words, here.</p></article>", "x"), (None, None, None)], "page_id long, html string, main string")
    out = html_extract.extract(pages)
    assert out.columns == ["page_id", "main", "_main"] and sorted((r["_main"]["text"], r["main"]) for r in out.collect() if r["page_id"]) == [("Words, here.", "x")]


def test_slices_cover_all_texts():
    from tidelake.llm import words

    column = pa.array(["ab", None, "", "c" * 50, "d"]).slice(1)
    seen = [bytes(data[a:b]).decode() for _, data, offsets in words.slices(column, 10) for a, b in zip(offsets[:-1], offsets[1:])]
    assert seen == ["", "", "c" * 50, "d"]


# --- columns of any name, and many copies --------------------------------------------


@pytest.mark.parametrize("run", [licenses.scan, simhash.cluster, lambda docs: sharding.assign(docs, 3)])
def test_other_columns_are_left_out(spark, run):
    """Columns that have the names of results, or of steps between, change nothing."""
    rows = [(k, t) for k, t in enumerate(["licensed under the mit license now", None, "", "a b c d e f g"] * 2)]
    plain = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    names = ("fingerprint", "component_id", "n_words", "labels", "shard", "slot", "size", "law", "score", "spans", "copies", "text_hash", "partition", "draw", "rank", "first", "root")
    more = plain.withColumns({c: F.lit("mine") for c in names})
    a, b = run(plain), run(more)
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_license_scan_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(licenses, "LOT", 7)
    rows = spark.range(45).select(F.lit(1).cast("long").alias("doc_id"), F.lit("under the mit license").alias("text")).unionByName(spark.range(1).select(F.lit(2).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    assert {tuple(r) for r in licenses.scan(rows).groupBy("doc_id").count().collect()} == {(1, 45), (2, 1)}


def test_long_entries_are_held_against_long_clean_words(spark):
    word = "x" * 50
    counts = spark.createDataFrame([(False, word[:-1] + "y", 3), (False, "stone", 9)], "stem boolean, entry string, other long")
    assert toxicity._near_misses(counts, [word], []) == {(False, word): 3}
