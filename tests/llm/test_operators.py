"""The numbered operators against brute-force versions, over copies, nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import decontamination, language_id, license_scan, line_dedup, quality_rules, repeats, simhash_dedup, source_mixing, suffix_dedup, superkmer_dedup, token_output
from kindred.llm.common import pack, unpack, written
from kindred.llm.components import components
from tests.llm.conftest import frame, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SMALL = {"batch_bytes": 20_000, "hot_count": 3}


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# --- 1 ------------------------------------------------------------------------------------------


def test_mixing_meets_targets_and_budget(spark, docs):
    rows = source_mixing.mixed_sample(docs, power=0.5, share=0.5).collect()
    tokens = sum(r.n_tokens for r in rows)
    for d in ("source", "lang", "topic"):
        total, weighed = Counter(), Counter()
        for r in rows:
            total[r[d]] += r.n_tokens
            weighed[r[d]] += r.n_tokens * r.weight
        flat = {k: v**0.5 for k, v in total.items() if v}
        for k, v in flat.items():
            assert weighed[k] / tokens == pytest.approx(v / sum(flat.values()), abs=2e-3)
    assert sum(r.n_tokens * r.probability for r in rows) / tokens == pytest.approx(0.5, abs=0.01)
    assert {r.text: r.n_tokens for r in rows} == {r.text: len(WORDS.findall(r.text or "")) for r in rows}
    assert all(r.drawn for r in rows if r.probability == 1) and not any(r.drawn for r in rows if r.probability == 0)
    again = source_mixing.mixed_sample(docs.repartition(2), power=0.5, share=0.5)
    assert got(again, "doc_id", "drawn") == sorted(((r.doc_id, r.drawn) for r in rows), key=str)


def test_raking_on_driver_and_in_spark_agree(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10.0), ("a", "y", "t", 30.0), ("b", "x", "u", 5.0), (None, "y", "u", 15.0), ("b", "y", "t", 20.0)], "source string, lang string, topic string, tokens double")
    targets = source_mixing.flattened(cells, 0.5)
    near = [[(*r[:4], round(r.weight, 5)) for r in sorted(source_mixing.raked(cells, targets, most_local=n).collect(), key=str)] for n in (100, 0)]
    assert near[0] == near[1]


def test_mixing_of_nothing(no_docs):
    assert source_mixing.mixed_sample(no_docs).count() == 0


# --- 2 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 1 << 31, (1 << 63) - 1])
def test_words_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64)
    ids[rng.random(n) < 0.5] //= np.uint64(max(1, top // 3))
    assert (token_output.decode_words(*token_output.encode_words(ids), n) == ids).all()


def test_token_files(spark, docs, rows, tmp_path):
    path = str(tmp_path / "ids")
    token_output.write_token_files(docs, path, TOKENIZER)
    encode, start, expected = Tokenizer.from_file(TOKENIZER).encode, 0, []
    for doc_id, text in sorted(rows, key=order):
        ids = [*encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, token_output.digest_token_files(spark, path).collect()), key=lambda r: r[1]) == [r[:4] for r in expected]
    assert [tuple(r) for r in token_output.read_token_files(spark, path).orderBy("start").collect()] == [(r[0], r[1], r[4]) for r in expected]


def test_token_files_of_nothing(spark, no_docs, tmp_path):
    token_output.write_token_files(no_docs, str(tmp_path / "ids"), TOKENIZER)
    assert token_output.digest_token_files(spark, str(tmp_path / "ids")).count() == 0


# --- 3 ------------------------------------------------------------------------------------------


def removed_bytes(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=order):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            x = t[i : i + length]
            if x in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(x)
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((doc_id, len(t), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, SMALL])
def test_suffix_dedup(docs, rows, options):
    part = [r for r in rows if r[0] not in (50, 51)] if options else rows
    d = docs.where("doc_id NOT IN (50, 51) OR doc_id IS NULL") if options else docs
    found = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(d, **options).collect()]
    assert sorted(found, key=str) == removed_bytes(part, 100)


@pytest.mark.parametrize("options", [{}, SMALL])
def test_repeat_groups(docs, rows, options):
    """Each group is one string with all its places, and together they cover every repeated window."""
    texts, part = {}, docs.where("doc_id < 50 AND doc_id <> 7")
    for d, t in rows:
        if d is not None and d < 50 and d != 7:
            texts[d] = (t or "").encode()
    groups = {}
    for r in suffix_dedup.repeat_groups(part, **options).collect():
        groups.setdefault((r["repeat"], r.n_bytes), []).append((r.doc_id, r.start))
    covered = set()
    for (_, n), places in groups.items():
        assert n >= 100 and len(places) > 1 and len({texts[d][s : s + n] for d, s in places}) == 1
        covered |= {(d, s + i) for d, s in places for i in range(n - 99)}
    windows = {}
    for d, t in texts.items():
        for i in range(len(t) - 99):
            windows.setdefault(t[i : i + 100], []).append((d, i))
    assert covered == {p for places in windows.values() if len(places) > 1 for p in places}
    x = max(groups.values(), key=len)
    assert len(x) >= 3


def test_maximal_repeats_are_maximal():
    text = b"#".join([b"abcdefgh" * 4 + b"XY", b"q" + b"abcdefgh" * 4 + b"XZ", b"r" + b"abcdefgh" * 4 + b"W"])
    places = [m.start() for m in re.finditer(b"abcd", text)]
    groups = suffix_dedup.maximal_repeats([text[max(0, p - 12) : p][::-1] for p in places], [text[p : p + 16] for p in places], 16, 4)
    strings = set()
    for members, left, right in groups:
        own = {text[places[i] - left : places[i] + right] for i in members}
        assert len(own) == 1 and left + right >= 16
        strings |= own
    every = [text[i:j] for i in range(len(text)) for j in range(i + 16, min(len(text), i + 28) + 1) if b"abcd" in text[i:j]]
    for x, n in Counter(every).items():  # every repeat of a suffix that is to group lies in a maximal one
        if n > 1 and len(x) == 16 and x.startswith(b"abcd"):
            assert any(x in s for s in strings)


def test_suffix_dedup_of_nothing(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


# --- 4 ------------------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files, to deal in the Software without restriction"
    rows = [(1, "Released UNDER the MIT   License. under the mit license"), (2, "Apache License, Version 2.0; cc-by-nc cc by\nnc"), (3, mit), (4, None), (5, ""), (6, "under the mit licenses"), (7, "mit"), (1, "Released UNDER the MIT   License. under the mit license"), (8, "under the Kmit license"), (9, "word " * 20_000 + "cc by nc")]
    upper = {c: c + 32 for c in range(65, 91)}
    expected = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(upper))
        places, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        expected.append((doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    result = license_scan.license_digest(license_scan.license_spans(frame(spark, rows)))
    assert got(result, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(expected, key=str)
    labels = {r.doc_id: (r.labels, r.score) for r in result.collect()}
    assert labels[3][0] == "mit" and 0.7 <= labels[3][1] < 1 and labels[7] == ("", 0.0) and labels[1][1] == 1.0


def test_license_scan_of_nothing(no_docs):
    assert license_scan.license_digest(license_scan.license_spans(no_docs)).count() == 0


# --- 5 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, SMALL])
def test_superkmer_dedup(docs, rows, options):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, (True, 0)), (d is not None, d or 0)) if key in first else (d is not None, d or 0)
    expected = []
    for d, w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (d is not None, d or 0):
                gone[i : i + 50] = b"\1" * 50
        expected.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    result = superkmer_dedup.remove_windows(docs, **options).withColumn("n", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"]))
    assert got(result, "doc_id", "n_words", "n", "kept") == sorted(expected, key=str)


def test_superkmer_dedup_of_nothing(no_docs):
    assert superkmer_dedup.remove_windows(no_docs).count() == 0


def test_window_minima():
    h = np.random.default_rng(5).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 7, 64):
        assert repeats.window_minima(h, width).tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(201 - width)]


# --- 6 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("part_bytes", [500_000, 300])
def test_decontamination(spark, part_bytes):
    items = [(i, prose(200 + i, 16 + 3 * i)) for i in range(9)] + [(20, "four words in all"), (21, ""), (22, None), (None, "x y z a b c")]
    flat = [" ".join(t.split()) if t else t for _, t in items]
    docs = [(i, prose(i, 50) + "\n" + (flat[i] or "") + " " + prose(40 + i, 40)) for i in range(9)]
    docs += [(10, flat[6].replace(flat[6].split()[3], "other", 1)), (11, prose(60, 300)), (12, None), (13, ""), (14, "say Four  words\nin all today"), (0, docs[0][1]), (15, " ".join(flat[5].split()[: len(flat[5].split()) // 2]))]
    expected = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        for i, item in items:
            x = (item or "").encode().lower().split()
            if not x or i is None:
                continue
            k, n = min(5, len(x)), len(x)
            want = Counter(tuple(x[j : j + k]) for j in range(n - k + 1))
            m = n - k + 1
            for s in range(len(w) - n + 1):
                have = Counter(tuple(w[j : j + k]) for j in range(s, s + m))
                both = sum((want & have).values())
                if both / (2 * m - both) >= 0.8:
                    expected[d, i] = max(expected.get((d, i), 0), both / (2 * m - both))
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes, known_bytes=2 * part_bytes).collect()}
    assert found == pytest.approx(expected) and len(expected) >= 10


def test_decontamination_of_nothing(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, none).count() == 0
    assert decontamination.contaminated(no_docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


# --- 7 ------------------------------------------------------------------------------------------


def test_quality_statistics(docs, rows):
    expected = []
    for d, text in rows:
        t = text or ""
        w = WORDS.findall(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        expected.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    own = docs.select("doc_id", "text")
    result = quality_rules.with_statistics(own).withColumn("failed", quality_rules.base_failed())
    assert got(result, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed") == sorted(expected, key=str)


def test_decision_list_learns_thresholds(spark):
    made = [(1 if not (x > 0.6 and y < 0.3) else 0, i % 3 == 0, x, y) for i, (x, y) in enumerate(np.random.default_rng(2).random((900, 2)).tolist())]
    rules = quality_rules.learn_rules(spark.createDataFrame(made, "_good int, _prune boolean, x double, y double"), ("x", "y"))
    judged = spark.createDataFrame(made, "_good int, _prune boolean, x double, y double").withColumn("bad", quality_rules.rejected(rules).isNotNull())
    wrong = judged.where("bad <> (_good = 0)").count()
    assert rules and wrong < 50 and all(len(r) <= 3 for r in rules) and judged.where("bad AND _good = 1").count() < 20


def test_quality_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    own = docs.select("doc_id", "text")
    result = quality_rules.judged(own, none)
    assert result.where("kept = base_failed").count() == 0 and result.count() == docs.count()
    assert quality_rules.judged(no_docs.select("doc_id", "text"), none).count() == 0


# --- 8 ------------------------------------------------------------------------------------------


def test_language_id(spark):
    vocabularies = {"aa": "brun kata solim peret onda vukki", "bb": "schnell hoch weiss zwerg fluss", "cc": "école été naïve garçon forêt"}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(vocabularies[l].split(), 30)), l) for i, l in enumerate(list(vocabularies) * 60)] + [(900, None, "aa"), (901, "12 34 -- ", "bb"), (902, "", None), (903, "schnell fluss hoch", None), (None, "été forêt garçon", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.held_out()
    learned = language_id.learn_filter(docs.where(~F.coalesce(out, F.lit(False))))
    found = {r.doc_id: r for r in language_id.predict(docs, *learned).collect()}
    for i, _, lang in rows[:180]:
        assert found[i].lang_pred == lang and found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= found[i].score <= 1
    assert [found[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "cc"] and found[900].score == 0
    none = language_id.learn_filter(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, *none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), *learned).count() == 0


def test_language_counts(spark):
    docs = spark.createDataFrame([("aa", "abcd abcd"), ("bb", "abcd"), ("aa", None)], "lang string, text string")
    run = int.from_bytes(b"abcd", "little")
    assert {r.lang: r.n for r in language_id.count_runs(docs).where(F.col("run") == run).collect()} == {"aa": 2, "bb": 1}


# --- 9 ------------------------------------------------------------------------------------------


def fingerprint(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    own = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in own]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def linked(prints, radius=4):
    n, parent = len(prints), list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(n):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("blocks", [2, 3])
def test_simhash_dedup(docs, rows, blocks):
    prints = [fingerprint(t) for _, t in rows]
    root = linked(prints)
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    expected = [(d, format(p, "016x"), least[r]) for (d, _), p, r in zip(rows, prints, root)]
    assert got(simhash_dedup.near_duplicates(docs, blocks=blocks), "doc_id", "fingerprint", "component_id") == sorted(expected, key=str)


@pytest.mark.parametrize("most", [20_000, 30])
def test_links_lose_nothing(spark, most):
    rng = np.random.default_rng(8)
    own = set()
    for c in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(25):
            x = c
            for b in rng.choice(64, rng.integers(0, 4), replace=False).tolist():
                x ^= 1 << b
            own.add(x)
    own = sorted(own)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in own], "fingerprint long").repartition(3)
    found = {r.node: r.root for r in components(simhash_dedup.links(df, most=most)).collect()}
    root = linked(own)
    groups = {}
    for x, r in zip(own, root):
        groups.setdefault(r, set()).add(int(np.uint64(x).astype(np.int64)))
    for members in groups.values():
        assert len({found.get(m, m) for m in members}) == 1
    assert len({found.get(int(np.uint64(x).astype(np.int64)), x) for x in own}) == len(groups)


def test_simhash_of_nothing(no_docs):
    assert simhash_dedup.near_duplicates(no_docs).count() == 0


def test_components_of_a_path(spark):
    n = 60
    got_ = components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long"))
    assert {r.node: r.root for r in got_.collect()} == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


# --- 10 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [2, 3, 5])
def test_line_dedup(docs, rows, least):
    seen, expected = set(), {}
    for d, text in sorted(set(rows), key=order):
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        gone = bytearray(len(lines))
        for i in range(len(lines) - least + 1):
            key = tuple(lines[i : i + least])
            if key in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(key)
        expected[d, text] = (d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g))
    result = [(r.doc_id, r.n_lines, r.n_removed, "\n".join(x for x in r.kept.split("\n") if WORDS.search(x))) for r in line_dedup.remove_repeated_lines(docs, least).collect()]
    assert sorted(result, key=str) == sorted((expected[r] for r in rows), key=str)
    assert sum(r[2] for r in result) > 0


def test_interval_tree(docs, rows):
    found, expected = {}, set()
    for r in line_dedup.interval_tree(docs).collect():
        found.setdefault((r.depth, r["rank"]), set()).add((r.doc_id, r.first_line, r.last_line))
    for depth in (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096):
        windows = {}
        for d, text in set(rows):
            lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if WORDS.search(x)]
            for i in range(len(lines) - depth + 1):
                windows.setdefault(tuple(x for _, x in lines[i : i + depth]), set()).add((d, text, lines[i][0], lines[i + depth - 1][0]))
        expected |= {(depth, frozenset((d, a, b) for d, _, a, b in w)) for w in windows.values() if len(w) > 1}
    got_ = {(depth, frozenset(w)) for (depth, _), w in found.items()}
    assert {x for x in got_ if len(x[1]) > 1} == {x for x in expected if len(x[1]) > 1} and max(d for d, _ in got_) >= 256


def test_line_dedup_of_nothing(no_docs):
    assert line_dedup.remove_repeated_lines(no_docs).count() == 0


# --- shared -------------------------------------------------------------------------------------


def test_pack_round_trip():
    x = np.empty(3, object)
    x[:] = [b"", b"ab", b"\x00;:#"]
    out = unpack(pack(a=np.arange(5), b=np.zeros((0, 3), np.int64), x=x))
    assert out["a"].tolist() == [0, 1, 2, 3, 4] and out["b"].shape == (0, 3) and out["x"].tolist() == x.tolist()


def test_written_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "x long, y string")
    assert sorted(map(tuple, written(df, "t").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
