"""Spelling variants, fill-in-the-middle and mixing against plain versions, and against SQL where there is any."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest

from foliospark.llm import infill, mixing, queries, variants


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, sf_dir, name):
    assert compare.same(queries.queries()[name](spark, sf_dir), compare.database(sf_dir), queries.oracle_sql()[name])


# --- spelling variants


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]])
    return out


def found_variants(docs, **k):
    rows = variants.variants(docs, **k).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("seed, letters, lengths", [(1, "ab", (7, 9)), (2, "abÀ", (7, 8)), (3, "aÿZ", (7, 12))])
def test_variants_equal_all_pairs(spark, seed, letters, lengths):
    rnd = random.Random(seed)
    known = ["".join(rnd.choice(letters) for _ in range(rnd.randint(*lengths))) for _ in range(150)]
    # frequencies over some powers of ten, so that forms chain
    rows = [(i, " ".join(w for w in rnd.sample(known, 60) for _ in range(rnd.choice([1, 1, 2, 30, 400])))) for i in range(8)]
    want = plain_variants(plain_words(rows))
    assert found_variants(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert any(v[0] for v in want.values())


def test_variants_chain_to_the_last_form(spark):
    words = {"abcdefgh": 2, "abcdefgx": 20, "abcdefyx": 200, "abcdefy": 2000, "bcdefy": 9}
    known = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(words.items())], "id long, word string, n long")
    near = {r["word"]: (r["n_near"], r["near"]) for r in variants.neighbours(known).collect()}
    assert near == {"abcdefgh": (1, "abcdefgx"), "abcdefgx": (2, "abcdefyx"), "abcdefyx": (2, "abcdefy"), "abcdefy": (2, "abcdefyx"), "bcdefy": (1, "abcdefy")}
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e")], "word string, form string")
    assert {r["word"]: r["root"] for r in variants.roots(forms, []).collect()} == dict.fromkeys("abcdx", "e")


def test_variants_of_long_words_and_any_letters(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh") for _ in range(40_000))
    words = [long, long[:20_000] + long[20_001:], long[:39_999], "a" * 3000, "a" * 3001, "😀é" * 5, "😀é" * 4 + "😀e", "", "x"]
    known = spark.createDataFrame([(i, w, 1 + i) for i, w in enumerate(words)], "id long, word string, n long")
    got = {r["word"]: (r["n_near"], r["near_n"], r["near"]) for r in variants.neighbours(known).collect()}
    assert got == {long: (2, 3, words[2]), words[1]: (1, 1, long), words[2]: (1, 1, long), words[3]: (1, 5, words[4]), words[4]: (1, 4, words[3]), words[5]: (1, 7, words[6]), words[6]: (1, 6, words[5]), "": (1, 9, "x"), "x": (1, 8, "")}


def test_variants_odd(spark, odd, nameless, empty):
    for docs in (odd, nameless):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert found_variants(docs) == plain_variants(plain_words(rows))
    assert found_variants(empty) == {}
    ties = spark.createDataFrame([(1, "aaaaaaab " * 30 + "aaaaaaac " * 30 + "aaaaaaad " * 3)], "doc_id long, text string")
    assert found_variants(ties)["aaaaaaad"][:2] == ("aaaaaaab", "aaaaaaab")


# --- fill-in-the-middle


def plain_infill(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def check_infill(docs):
    from pyspark.sql import functions as F

    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
    want = sorted(((i, *plain_infill(i, t), t or "") for i, t in rows), key=repr)
    done = infill.transform(docs).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_units", "middle_units", "output", "back")) for r in done.collect()), key=repr)
    assert got == want
    return Counter(r[2] for r in got)


def test_infill_equals_plain(spark, odd, nameless, empty):
    rnd = random.Random(2)
    pieces = ["<P>", "<S", ">", "<", "P>", "M>", "é", "😀", "a", " ", "\n", "́", "\x00", "<M"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(400)] + ["äöü😀x" * 9000]
    forms = check_infill(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert min(forms[k] for k in ("plain", "psm", "spm")) > 20
    check_infill(odd), check_infill(nameless)
    assert not check_infill(empty)


@pytest.mark.parametrize("unit", sorted(infill.UNITS))
@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 4096])
def test_places_of_all_ranks(unit, chunk):
    rnd = random.Random(chunk)
    texts = ["", "a", "\n\n", *("".join(rnd.choice("ab \né😀") for _ in range(rnd.randint(0, 40))) for _ in range(40))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    chunks = infill.begun(data, at, infill.UNITS[unit], chunk)
    for i, t in enumerate(texts):
        begins = {"char": lambda k: True, "word": lambda k: t[k - 1] in " \n" and t[k] not in " \n", "line": lambda k: t[k - 1] == "\n"}[unit]
        want = [len(t[:k].encode()) for k in range(len(t)) if k == 0 or begins(k)]
        n = int(chunks[1][chunks[2][i + 1]] - chunks[1][chunks[2][i]])
        got = [infill.place(data, at, i, r, infill.UNITS[unit], chunks) - int(at[i]) for r in range(n + 1)]
        assert got == [*want, len(t.encode())]


def test_infill_cuts_at_words_and_lines(spark):
    text = "one two  three\nfour five\n\nsix " * 40
    docs = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")
    for unit, ends in (("word", r"[ \n]$"), ("line", r"\n$")):
        for r in infill.transform(docs, unit=unit).filter("form = 'psm'").collect():
            prefix, rest = r["output"][3:].split("<S>")
            suffix, middle = rest.split("<M>")
            assert prefix + middle + suffix == text
            assert all(not x or re.search(ends, x) for x in (prefix, middle))


# --- mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cut, total = set(), sum(sizes.values())
    while True:
        left = total - 3 * sum(sizes[s] for s in cut)
        share = sum(w for s, w in weight.items() if s not in cut)
        target = {s: 3 * sizes[s] if s in cut else left * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s]}
        if not over:
            return target
        cut |= over


def check_mix(docs, labels=None):
    rows = mixing.mix(mixing.sized(docs, labels)).collect()
    assert len(rows) == docs.count()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
    want = plain_targets(sizes)
    for r in rows:
        assert math.isclose(r["target"], want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
        assert len({r["copies"] for r in rows if r["source"] == s and r["size"]}) <= 2  # complete epochs, and one that isn't
    return rows


def test_mix_meets_targets(spark, sf_dir, odd, nameless, empty):
    read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = check_mix(read, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in read.collect()} == {r["doc_id"]: r["size"] for r in rows}
    for docs in (odd, nameless):
        check_mix(docs)
    assert mixing.mix(mixing.sized(empty)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_mix_targets_by_resharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i:02}": rnd.choice([0, 1, 10, 1000, 100_000]) * rnd.randint(1, 9) for i in range(rnd.randint(1, 14))} | ({None: 70} if seed % 2 else {})
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in got)


def test_mix_takes_smallest_keys_of_one_hot_source(spark):
    rnd = random.Random(1)
    docs = [(i, "hot" if i % 3 else f"s{i % 7}", rnd.choice([0, 1, 5, 50, 4000]), rnd.choice([0.5, 1.0, 2.0])) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long, weight double")
    rows = mixing.mix(df).join(mixing.keyed(df).select("doc_id", "key"), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for each in by.values():
        each = [r for r in sorted(each, key=lambda r: r["key"]) if r["size"]]
        copies = [r["copies"] for r in each]
        assert copies == sorted(copies, reverse=True)
    # heavier documents come first more often
    drawn = defaultdict(list)
    for r in by["hot"]:
        drawn[r["weight"]].append(r["key"])
    assert np.mean(drawn[2.0]) < np.mean(drawn[1.0]) < np.mean(drawn[0.5])


def test_mix_of_repeated_rows_and_copies(spark):
    docs = [(1, "a", 10, 1.0)] * 50 + [(None, None, 3, None)] * 4 + [(2, "b", 7, 0.0), (3, "b", 9, 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long, weight double").selectExpr("*", "'y' AS bucket_of")
    rows = mixing.mix(df).collect()
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    want = plain_targets({"a": 500, "b": 16, None: 12})
    assert abs(taken["a"] - want["a"]) <= 5 and abs(taken["b"] - want["b"]) <= 5 and taken[None] == want[None] == 36
    mixed = mixing.mix(df)
    assert mixing.copies(mixed).count() == sum(r["copies"] for r in rows)
