"""Every operator against brute force on hostile rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import json
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import chat, components, decontam, linedup, mixing, pseudonym, quality, queries, repeats, rules, simhash, sql, tokens
from millrace.llm.common import map_arrow
from tests.compare import connect, rows

WORD = re.compile("[^\x20\x09-\x0D]+")
TERM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "id string, row string, fp int, key string, words string, measures string, n int, _text string, s long, spans string"


def hostile() -> list[tuple]:
    """(doc_id, text): ids repeat and are null, texts repeat, are null, empty, blank, odd and long."""
    rng = random.Random(5)
    vocabulary = ["the", "of", "Ünder", "été", "naïve", "x", "data", "Model", "K", "İz", "emoji😀", "don't", "a.b", "42"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(400)
    texts = [None, "", " ", "\n\t \x0b", "one", "two words", base, base, base + " tail", "head " + base, say(3000), "a" * 5000, "ab" * 900, "\x00\x1c\x85\xa0 odd spaces　here", "tab\tand\r\nreturn\n\nline\nline\n line\nline", say(20) + "\n" + base[:900] + "\n" + say(9)]
    texts += [say(rng.randint(1, 60)) for _ in range(20)] + [base[i : i + 700] for i in (0, 13, 400)]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(6, base), (4, "another text of doc four"), (None, base), (None, "no id"), (None, None), (77, "the the the the the the the the the the the the")]


@pytest.fixture(scope="module")
def docs(spark):
    """The hostile rows with columns whose names the operators might use themselves."""
    df = spark.createDataFrame(hostile(), "doc_id long, text string")
    for name, kind in (c.split(" ") for c in CLASH.split(", ")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a")).withColumn("n_chars", F.length("text").cast("long"))


def as_set(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# Rules


def ledger_of(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_rule_ledger(docs):
    got = as_set(rules.ledger(docs), "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == Counter((i, *ledger_of(t)) for i, t in hostile())


def test_policies_and_ablation(docs):
    entries = rules.ledger(docs).cache()
    n_kept = entries.where(rules.passes("2026-11")).count()
    for r in rules.ablation(entries, "2026-11").collect():
        others = tuple(x for x in rules.POLICIES["2026-11"] if x != r.rule)
        assert r.n_kept_without == entries.where(rules.passes(others)).count() == n_kept + r.n_alone
    kept = rules.keep_by_policy(docs)
    assert kept.columns == docs.columns and kept.count() == n_kept
    assert rules.ablation(entries.limit(0), "base").count() == 2


# SimHash


def plain_fingerprint(text, width=3):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, distance):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash_components(docs):
    fps = [plain_fingerprint(t) for _, t in hostile()]
    of = classes(set(fps), 3)
    name = {}
    for (i, _), f in zip(hostile(), fps):
        if i is not None:
            name[of[f]] = min(i, name.get(of[f], i))
    got = as_set(simhash.near_duplicates(docs), "id", "fp", "component_id")
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert got == Counter((i, signed(f), name.get(of[f])) for (i, _), f in zip(hostile(), fps))


@pytest.mark.parametrize("crowd", [1024, 6])
def test_simhash_links_keep_all_connections(spark, crowd):
    rng = random.Random(crowd)
    fps = set()
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in components.connected_components(simhash.links(df, 3, crowd)).collect()}
    want, seen = classes(fps, 3), {}
    for f in fps:
        mine = roots.get(simhash._signed(f), simhash._signed(f))
        assert seen.setdefault(want[f], mine) == mine
    assert len(set(seen.values())) == len(seen)


def test_one_of_each(docs):
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    found = simhash.near_duplicates(docs)
    assert left.count() == found.select("component_id").distinct().count()
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_component_keeps_unrelated_documents(spark, docs):
    import corpus_pipeline

    of = classes({plain_fingerprint(t) for _, t in hostile()}, 3)
    first = {}
    for i, t in hostile():
        first.setdefault(of[plain_fingerprint(t)], []).append((i is None, i or 0, i, t))
    left = corpus_pipeline.near_duplicates(spark, docs, None)
    assert left.columns == docs.columns
    got = Counter((r.doc_id, of[plain_fingerprint(r.text)]) for r in left.collect())
    assert got == Counter((min(x[:3] for x in rows)[2], c) for c, rows in first.items())
    unrelated = [(None, "no name and first text"), (None, "another text without a name"), (4, "one two three"), (4, "something else entirely here"), (4, "something else entirely here")]
    df = spark.createDataFrame(unrelated, "doc_id long, text string")
    assert as_set(corpus_pipeline.near_duplicates(spark, df, None), "doc_id", "text") == Counter(set(unrelated))
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), None).count() == 0


def test_components_on_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(50)} == {1000}


# Winnowing


def plain_contamination(texts, items):
    windows = {}
    for i, t in items:
        w = TERM.findall((t or "").translate(LOW))
        for j in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[j : j + 10]), set()).add(i)
    for i, t in texts:
        w = TERM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= items_here
        yield i, len(w), len(hit), ",".join(sorted(map(str, found)))


def test_contamination(spark, docs):
    by = dict(hostile())
    items = [(1, " ".join(by[6].split()[50:75])), (2, "the the the"), (3, None), (4, ""), (5, by[6][:300].upper().replace("É", "é")), (6, "x x x x x x x x x x x"), (7, "nothing like this stands anywhere in the documents at all today"), (2, "the the the"), (10, "another TEXT"), (11, by[8])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontam.contamination(docs, bench).select("id", "n_words", "n_hit", F.array_join("items", ","))
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_contamination(hostile(), items))
    clean = decontam.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(1 for r in plain_contamination(hostile(), items) if not r[2])
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(docs.limit(0), bench).count() == decontam.remove_contaminated(docs.limit(0), bench).count() == 0


def test_contamination_of_a_very_long_text_by_shuffle(spark, monkeypatch):
    rng = random.Random(6)
    words = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(60_000)]
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(1, " ".join(words)), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(words[i * 100 : i * 100 + 40])) for i in range(0, 600, 2)], "item_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, len(r["items"])) for r in decontam.contamination(df, bench).collect()}
    assert got == {1: (60_000, 300 * 40, 300), 2: (3, 0, 0)}


# Repeats


def plain_repeats(texts, length):
    count = Counter()
    raw = [(t or "").encode() for _, t in texts]
    for b in raw:
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    for (i, _), b in zip(texts, raw):
        gone = np.zeros(len(b) + 1, dtype=int)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j] += 1
                gone[j + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        yield i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()


def plain_cover(raw, length):
    count = Counter(b[j : j + length] for b in raw for j in range(len(b) - length + 1))
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=int)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j] += 1
                gone[j + length] -= 1
        yield np.concatenate([[0], (np.cumsum(gone)[: len(b)] > 0).astype(int), [0]])


@pytest.mark.parametrize("length,gram,crowd", [(400, 160, 4096), (60, 24, 4096), (60, 40, 2)])
def test_repeats(docs, length, gram, crowd):
    passage = (length * 5 // 8, gram * 5 // 8)
    got = repeats.without_repeats(docs, length=length, gram=gram, crowd=crowd, passage=passage, passage_words=6)
    raw = [(t or "").encode() for _, t in hostile()]
    passages = [sum(len(b[s:e].split()) >= 6 for s, e in zip(np.flatnonzero(np.diff(c) == 1), np.flatnonzero(np.diff(c) == -1))) for b, c in zip(raw, plain_cover(raw, passage[0]))]
    want = Counter((*row[:4], n, row[4]) for row, n in zip(plain_repeats(hostile(), length), passages))
    assert as_set(got, "id", "n_bytes", "n_removed", "n_spans", "n_passages", "kept_sha256") == want


@pytest.mark.parametrize("kind", ["decimal(10,0)", "date", "string"])
def test_repeats_of_other_ids(spark, kind):
    base = "".join(random.Random(1).choice("abcdef ") for _ in range(900))
    ids = {"decimal(10,0)": "id", "date": "date_add('2020-01-01', cast(id as int))", "string": "id"}[kind]
    df = spark.createDataFrame([(i, x + base[i * 40 :]) for i, x in enumerate(("", "other", "third", "x"))], "id long, text string").select(F.expr(f"cast({ids} as {kind})").alias("doc_id"), "text")
    got = repeats.without_repeats(df, with_text=False)
    assert got.schema["id"].dataType.simpleString() == kind and got.where("n_removed > 700").count() == 4
    assert repeats.without_repeats(df.limit(0)).count() == repeats.repeat_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [4096, 2])
def test_repeat_groups_hold_all_occurrences(docs, crowd):
    length = 60
    raw = Counter((i, (t or "").encode()) for i, t in hostile())
    found, covered = {}, set()
    texts = {}
    for i, t in hostile():
        texts.setdefault(i, []).append((t or "").encode())
    for r in repeats.repeat_groups(docs, length=length, gram=40, crowd=crowd).join(docs.select(F.col("doc_id").alias("_i"), F.col("text").alias("_t"), F.xxhash64("text").alias("_r")).distinct(), F.expr("id <=> _i and row = _r")).collect():
        own = (r._t or "").encode()[r.start : r.start + r.length]
        assert len(own) == r.length >= length
        found.setdefault(r.grp, (own, []))[1].append((r.id, r.row, r.start))
        assert found[r.grp][0] == own
        covered.update((r.id, r.row, p) for p in range(r.start, r.start + r.length))
    places = Counter()
    for (i, b), n in raw.items():
        for j in range(len(b) - length + 1):
            places[b[j : j + length]] += n
    for own, at in found.values():
        # No occurrence is missing; groups share their strings with others that extend them, so a group's own may be more.
        assert len(at) > 1 and (len(own) > length or crowd == 2 or len(at) == places[own])
    want = {(i, x, p) for (i, t), c in zip(hostile(), plain_cover([(t or "").encode() for _, t in hostile()], length)) for x in [t] for p in np.flatnonzero(c[1:])}
    assert len({(i, p) for i, _, p in covered}) == len({(i, p) for i, _, p in want})


def test_repeat_groups_are_maximal_and_whole():
    rng = random.Random(3)
    texts = {"".join(rng.choice("ab") for _ in range(6)) + "ANCHOR" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(30)}
    before, after = zip(*[(t[:6].encode(), t[6:].encode()) for t in sorted(texts)])
    got = {(back, on, tuple(m.tolist())) for back, on, m in repeats.Tree(list(before), list(after)).groups(9)}
    same = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    want = set()
    for i in range(len(before)):
        for j in range(i):
            back, on = same(before[i][::-1], before[j][::-1]), same(after[i], after[j])
            if back + on >= 9:
                members = [k for k in range(len(before)) if same(before[k][::-1], before[i][::-1]) >= back and same(after[k], after[i]) >= on]
                want.add((back, on, tuple(members)))
    assert got == want
    counted = repeats.Tree(list(before), list(after), [2] + [1] * (len(before) - 1)).groups(9)
    assert {(back, on, tuple(m.tolist())) for back, on, m in counted} - want == {(6, 12, (0,))}


def test_long_documents_go_in_slices(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 500)
    offsets = np.array([0, 100, 2100, 2150, 2300])
    covered = Counter()
    for x, y, owner, starts, ends in repeats._slices(offsets, 60):
        for r, s, e in zip(owner, starts, ends):
            covered.update((int(r), int(x + p)) for p in range(s, e - 59))
    want = {(r, p) for r in range(4) for p in range(offsets[r], offsets[r + 1] - 59)}
    assert set(covered) == want and max(covered.values()) == 1


# Lines


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, line, letters="abcdé "):
    out = list(line)
    for _ in range(rng.randint(0, 3)):
        p, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.4 or not out:
            out.insert(p, rng.choice(letters))
        elif kind < 0.7:
            out.pop(p % len(out))
        else:
            out[p % len(out)] = rng.choice(letters)
    return "".join(out)


def test_edits():
    rng = random.Random(2)
    for _ in range(2000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = changed(rng, a, "abcé")
        c = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        for most in (0, 1, 2, 3, 5):
            assert linedup.edits(a, b, most) == min(plain_edits(a, b), most + 1)
            assert linedup.edits(a, c, most) == min(plain_edits(a, c), most + 1)


@pytest.mark.parametrize("crowd", [4096, 3])
def test_line_links_are_all_found(spark, crowd):
    rng = random.Random(9)
    bases = ["".join(rng.choice("abcde ") for _ in range(rng.randint(14, 30))) for _ in range(10)]
    lines = [changed(rng, rng.choice(bases)) for _ in range(160)]
    texts = ["\n".join(rng.sample(lines, 4)) for _ in range(50)] + ["", None, " \n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    different = sorted({x for t in texts if t for x in t.split("\n") if len(x) >= 16 and x.strip()})
    want = {(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if plain_edits(a, b) <= 2}
    names = {hashlib.md5(x.encode()).digest(): x for x in different}
    got = Counter(tuple(sorted((names[bytes(r.a)], names[bytes(r.b)]))) for r in linedup.line_links(df, least=16, crowd=crowd).collect())
    assert set(got) == want and max(got.values()) == 1


def plain_links(texts, threshold=2):
    different = sorted({x for t in texts if t for x in t.split("\n") if WORD.search(x)})
    return different, {(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if abs(len(a) - len(b)) <= threshold and plain_edits(a, b) <= threshold}


@pytest.mark.parametrize("crowd", [4096, 3])
def test_short_lines_are_linked_too(spark, tmp_path, monkeypatch, crowd):
    rng = random.Random(crowd)
    lines = ["With, to to.", "With to to.", "Page 12 of 40", "Page 13 of 40", "a", "é", "ab", "xyz", " z "]
    lines += [changed(rng, "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 18)))) for _ in range(120)]
    texts = ["\n".join(rng.sample(lines, 4)) for _ in range(60)] + ["\n".join(lines[:9]), "", None, " \n\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    _, want = plain_links(texts)
    degree = Counter(x for pair in want for x in pair)
    by_document = linedup.by_document
    monkeypatch.setattr(linedup, "by_document", lambda docs, **more: by_document(docs, crowd=crowd, **more))
    got = {r.doc_id: r.n_links for r in queries.op4_line_edit_join(spark, str(tmp_path)).collect()}
    assert got == {i: sum(degree[x] for x in (t or "").split("\n")) for i, t in enumerate(texts)}


def plain_links_at_once(lines, threshold=2):
    """The links among equally long lines: the rows of plain_edits, for all pairs side by side."""
    codes = np.array([[ord(c) for c in x] for x in lines])
    i, j = np.triu_indices(len(lines), 1)
    a, b = codes[i].T, codes[j].T
    row = [np.full(len(i), n, dtype=np.int16) for n in range(len(a) + 1)]
    for n, x in enumerate(a, 1):
        new = [np.full(len(i), n, dtype=np.int16)]
        for m, y in enumerate(b, 1):
            new.append(np.minimum(np.minimum(new[-1], row[m]) + 1, row[m - 1] + (x != y)))
        row = new
    near = np.flatnonzero(row[-1] <= threshold)
    return {(lines[i[k]], lines[j[k]]) for k in near}


@pytest.mark.parametrize("crowd", [2, 1000])
def test_a_family_under_one_key_stays_bounded(spark, monkeypatch, crowd):
    rng = random.Random(crowd)
    lines = sorted({f"The invoice with number {rng.randrange(10**4):04} has been paid" for _ in range(600)})
    groups = []
    monkeypatch.setattr(linedup, "map_arrow", lambda df, run, schema: (groups.append(df.groupBy("key").count().agg(F.max("count")).first()[0]) if schema.startswith("kind") else None, map_arrow(df, run, schema))[1])
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    names = {hashlib.md5(x.encode()).digest(): x for x in lines}
    got = Counter(tuple(sorted((names[bytes(r.a)], names[bytes(r.b)]))) for r in linedup.line_links(df, crowd=crowd).collect())
    assert plain_links_at_once(lines[:40]) == plain_links(lines[:40])[1]
    assert set(got) == plain_links_at_once(lines) and max(got.values()) == 1
    assert len(groups) == 1 if crowd == 1000 else groups[-1] <= 2 * 16 * crowd


def test_line_classes(docs):
    lines = [(i, xxhash.xxh64_intdigest((t or "").encode(), 42), no, x) for i, t in hostile() if t is not None for no, x in enumerate(t.split("\n")) if WORD.search(x)]
    different = sorted({x for *_, x in lines})
    root = {x: x for x in different}
    find = lambda x: x if root[x] == x else find(root[x])
    degree = Counter()
    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and linedup.edits(a, b, 2) <= 2:
                degree[a] += 1
                degree[b] += 1
                root[find(b)] = find(a)
    got = linedup.line_classes(docs).collect()
    assert Counter((r.id, r.no) for r in got) == Counter((i, no) for i, _, no, _ in lines)
    assert sum(r.n_links for r in got) == sum(degree[x] for *_, x in lines)
    assert len({(r.class_id, r.class_no, r.class_row) for r in got}) == len({find(x) for x in different})
    want = {}
    for r in got:
        n, linked, removed, classes = want.get(r.id, (0, 0, 0, set()))
        want[r.id] = (n + 1, linked + r.n_links, removed + (not r.first), classes | {r.class_id} - {None})
    by = {r.id: (r.n_lines, r.n_links, r.n_removed, set(r.classes)) for r in linedup.by_document(docs).collect()}
    assert by == {i: want.get(i, (0, 0, 0, set())) for i in {i for i, _ in hostile()}}
    assert linedup.by_document(docs.limit(0)).count() == 0


# Tokens


def test_packing_is_exact():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 4000):
        for top in (1, 2, 49_408, 2**32 - 1):
            ids = rng.integers(0, top, n).astype(np.uint32)
            ids[::17] = top
            payload = tokens.pack(ids)
            assert (tokens.unpack(payload) == ids).all()
            for a, b in ((0, n), (n // 3, n // 2), (250, 260)):
                assert (tokens.unpack(payload, a, b) == ids[a:b]).all()


ODD_TEXTS = ["It's DON'T we'Ll 'tis ''s", "<|endoftext|> x<|startoftext|>y", "½ ² ª º ß İ ſ ŉ Ǆ", "é ́a áb", "ΑΣ ΣΑΣ. Σ", "日本語 テスト한국어", "١٢٣ ๓", " \n", "\x0b a  b\r\n\x1c", "w " * 30_000]


@pytest.mark.parametrize("name,by_word", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_the_library(data, monkeypatch, name, by_word):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "WORDS", 7)
    monkeypatch.setattr(tokens, "STRETCH", 50)
    monkeypatch.setattr(tokens, "MEMO", 100)
    path = public_tokenizers.path(name)
    whole, ours = Tokenizer.from_file(path), tokens.Encoder(path)
    assert ours.by_word == by_word
    texts = [t for _, t in hostile()] + ODD_TEXTS
    texts += pd.read_parquet(f"{data}/documents.parquet").text.tolist()
    texts += pd.read_parquet(f"{data}/pages.parquet").html.tolist()[:50]
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    got = list(ours.encode(pa.array(texts), 1))
    assert np.concatenate([n for _, n in got]).tolist() == [len(w) for w in want]
    assert np.concatenate([i for i, _ in got]).tolist() == [i for w in want for i in w]
    assert not list(ours.encode(pa.array([], pa.string()), 1))


@pytest.mark.parametrize("memo", [0, 1, 40, 10**6])
def test_words_of_earlier_stretches_keep_their_ids(data, monkeypatch, memo):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "STRETCH_BYTES", 700)
    monkeypatch.setattr(tokens, "MEMO", memo)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, ours = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = [t for _, t in hostile()] + ODD_TEXTS + pd.read_parquet(f"{data}/documents.parquet").text.tolist()[:60]
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for part, expected in ((pa.array(texts), want), (pa.array(texts[::-1]), want[::-1]), (pa.array(["", *texts]).slice(1), want)):
        ids, sizes = map(np.concatenate, zip(*ours.encode(part, 1)))
        assert [x.tolist() for x in np.split(ids, sizes.cumsum())] == [*expected, []]
        assert len(ours.kept) == len(ours.counts) <= memo and len(ours.ids) == ours.counts.sum()


def test_kept_words_take_little_memory():
    """A word kept with its ids took 149 bytes as objects of Python; workers keep them while other stages run."""
    ours, words = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")), 60_000
    texts = pa.array([" ".join(f"{i * 1_000_003 % 999_983:x}" for i in range(x, x + 100)) for x in range(0, words, 100)])
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for _ in ours.encode(texts, 1):
            pass
        assert tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow < 60 * words
    finally:
        tracemalloc.stop()


def test_only_the_known_chain_is_cut_at_spaces():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        spec = json.load(f)
    assert tokens.cuts_at_spaces(spec)
    assert not tokens.cuts_at_spaces(spec | {"normalizer": None})
    assert not tokens.cuts_at_spaces(spec | {"added_tokens": [spec["added_tokens"][0] | {"content": "a b"}]})
    assert not tokens.cuts_at_spaces(spec | {"pre_tokenizer": {"type": "Whitespace"}})


def test_token_rows(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(tokens.token_rows(docs, public_tokenizers.path("word_bpe_49k.json")).collect(), key=lambda r: r.start)
    ids = [r.id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((i, zlib.crc32(np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes())) for i, t in hostile())
    assert Counter((r.id, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert tokens.token_rows(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# Pseudonyms

PERSONAL = "on 2024-02-29, 31/12/1999 and 2023-02-30 or 1899-12-31; 4111 1111 1111 1111 or 4111-1111-1111-1112 +44 (020) 555-1234 an.A9@b.co 1.2.3.4. 999.1.1.1 4111111111111111"


def test_pseudonyms_keep_formats_and_come_back(spark):
    texts = [(1, PERSONAL), (2, PERSONAL.replace("1.2.3.4", "1.2.3.5")), (2, None), (None, ""), (4, "é" + PERSONAL * 40)]
    df = spark.createDataFrame(texts, "id long, text string").withColumnRenamed("id", "doc_id").withColumn("n_card", F.lit("x"))
    out = pseudonym.pseudonymize(df, "k")
    got = {r.id: r for r in out.where("id <> 2 or text is not null").collect()}
    one = got[1]
    assert (one.n_date, one.n_card, one.n_phone, one.n_mail, one.n_address) == (2, 2, 1, 1, 1)
    for kept in ("2023-02-30", "1899-12-31", "4111-1111-1111-1112", "999.1.1.1", "+44 (", "@b.co"):
        assert kept in one.text
    for gone in ("2024-02-29", "31/12/1999", "4111 1111 1111 1111", "555-1234", "an.A9@", "1.2.3.4."):
        assert gone not in one.text
    cards = re.findall(r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{16}", one.text)
    assert len({re.sub(" ", "", c) for c in cards}) == 1  # equal values stay equal, whatever their grouping
    digits = [int(c) for c in cards[0] if c != " "][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    back = pseudonym.pseudonymize(out.select(F.col("id").alias("doc_id"), "text"), "k", undo=True)
    assert Counter(tuple(r) for r in back.select("id", "text").collect()) == Counter(texts)


def test_permutations_are_one_to_one(spark):
    some = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert some.select(pseudonym.permute_digits(F.col("d"), "k").alias("p")).distinct().count() == 1000
    days = spark.range(73000).select(pseudonym.permute_pair(F.floor(F.col("id") / 292), F.col("id") % 292, 250, 292, "k").alias("p"))
    assert days.distinct().count() == 73000


# Quality


def test_quality_on_held_out_rows(spark, data):
    got = queries.op8_nbsvm_quality(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(6, 1), (7, 1), (11, 0), (12, 0), (None, 1), (8, None), (6, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).where("score between 0 and 1").count() == docs.count()
    alike = quality.fit(docs, labels.limit(0))
    assert quality.score(docs, alike).select("score").distinct().count() == 1


def test_descent_solves_the_dual():
    rng = np.random.default_rng(1)
    found = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(200)]
    y = np.array([1 if (r < 20).sum() > 3 else 0 for r in found])
    w, bias = quality.descend(found, y, np.ones(50), epochs=200)
    margin = np.array([w[r].sum() / np.sqrt(8) + bias for r in found])
    assert ((margin > 0) == (y == 1)).mean() > 0.9


# Mixing


@pytest.mark.parametrize("bound", [100, 1])
def test_raking_meets_its_marginals(spark, bound):
    cells = spark.createDataFrame([(s, g, t, 10 * (i + 1)) for i, (s, g, t) in enumerate((s, g, t) for s in ("a", "b", None) for g in ("x", "y") for t in ("p", "q"))], "s string, g string, t string, tokens long")
    targets = {"s": {"a": 0.5, "b": 0.3}, "g": {"x": 0.6, "y": 0.4}, "t": {"p": 0.5, "q": 0.5}}
    got = mixing.cell_probabilities(cells, ["s", "g", "t"], targets, keep=0.4, max_cells=bound)
    for r in mixing.marginals(got, ["s", "g", "t"], targets).collect():
        assert abs(r.share - (0.2 if r.category is None else r.target)) < 1e-6
    got = got.toPandas()
    assert abs((got.tokens * got.probability).sum() / got.tokens.sum() - 0.4) < 1e-6
    smooth = mixing.cell_probabilities(cells, ["s", "g"], {"s": None}, max_cells=bound)
    assert max(abs(r.share - r.target) for r in mixing.marginals(smooth, ["s", "g"]).collect()) < 1e-6


@pytest.mark.parametrize("bound", [100, 1])
def test_raking_edges(spark, bound):
    cells = lambda *rows: spark.createDataFrame(rows, "s string, tokens long")
    rake = lambda df, **more: {r.s: (r.weight, r.probability) for r in mixing.cell_probabilities(df, ["s"], max_cells=bound, **more).collect()}
    assert rake(cells(("a", 0), ("b", 0))) == {"a": (0.0, 1.0), "b": (0.0, 1.0)}
    assert rake(cells(("a", 0)).limit(0)) == {}
    got = rake(cells(("a", 0), ("b", 10), ("c", 10)), targets={"s": {"a": 0.5}}, keep=1.0)
    assert got["a"] == (0.0, 1.0) and abs(got["b"][1] - 1) < 1e-9 and abs(got["c"][1] - 1) < 1e-9
    got = rake(cells(("a", 1), ("b", 1000)), targets={"s": {"a": 0.9, "b": 0.1}}, keep=0.5)
    assert got["a"][1] == 1 and abs(got["b"][1] - 499.5 / 1000) < 1e-9


def test_query_targets_are_met(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mixing.mixture(docs, targets=queries.MIX)
    shares = rows.groupBy("lang").agg((F.sum(F.col("n_tokens") * F.col("weight"))).alias("m")).toPandas().set_index("lang").m
    for lang, share in queries.MIX["_lang"].items():
        assert abs(shares[lang] / shares.sum() - share) < 1e-6


def test_mixture_and_sample_agree(docs):
    got = mixing.mixture(docs)
    assert got.count() == docs.count()
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert mixing.sample(docs.limit(0)).count() == 0


# Chat


def test_chat_reads_back(spark):
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "assistant", "<|end|>\\l|<|turn|>\\\\s\\s"), (2, 0, None, None), (2, 0, "assistant", "same turn"), (None, 5, "assistant", "no conversation"), (3, None, "user", "<" * 5 + "|>")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(1))
    out = chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("lost")).collect()}
    for conv in (1, 2, 3, None):
        want = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in talk if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in want]
        assert got[conv].lost == "".join(x for _, r, x in want if r == "assistant")


def test_chat_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, n=None: (kind, text, ref, n)
    turns = [(1, 0, "user", [part("text", "see"), part("image", ref="s3://a", n=256), part("text", "<|image:0|>"), part("audio", ref="b", n=40)]), (1, 1, "assistant", [part("text", "ok"), part("document", ref="c")]), (1, 2, "user", None), (1, 3, "user", [part("other", "kept")])]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.format_chats(df)
    row = out.first()
    assert row.formatted == "<|turn|>user<|says|>see<|image:0|>\\l|image:0|><|audio:1|><|end|><|turn|>assistant<|says|>ok<|document:2|><|end|><|turn|>user<|says|><|end|><|turn|>user<|says|>kept<|end|>"
    assert [(a.n, a.turn, a.kind, a.ref, a.n_tokens) for a in row.attachments] == [(0, 0, "image", "s3://a", 256), (1, 0, "audio", "b", 40), (2, 1, "document", "c", 0)]
    assert row.n_expanded == 296
    read = out.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("lost")).first()
    assert [tuple(p) for p in read.t[0].parts] == [("text", "see", None), ("image", None, 0), ("text", "<|image:0|>", None), ("audio", None, 1)]
    assert [t.text for t in read.t] == ["see<|image:0|>", "ok", "", "kept"] and read.lost == "ok"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_parts_cannot_forge_control_strings(spark):
    rng, marks = random.Random(4), ["<", "|", "\\", "|turn|>", "<|end|>", "a<", "l|", "s", "image:0|>", "|says|>x", "<|image:1|>", "\n"]
    chats = []
    for c in range(150):
        for t in range(rng.randint(1, 3)):
            parts = [(rng.choice(["text", "text", "text", "image", "audio", "document", None]), "".join(rng.choices(marks, k=rng.randint(0, 3))), "r", 1) for _ in range(rng.randint(0, 5))]
            chats.append((c, t, rng.choice(["user", "assistant", "a<|says|>"]), parts))
    df = spark.createDataFrame(chats, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chats(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("lost")).collect()}
    for c in range(150):
        want, n = [], 0
        for _, _, role, parts in (x for x in chats if x[0] == c):
            flat = []
            for kind, text, *_ in parts:
                if kind in ("image", "audio", "document"):
                    flat.append((kind, None, n))
                    n += 1
                elif flat and flat[-1][0] == "text":
                    flat[-1] = ("text", flat[-1][1] + text, None)
                elif text:
                    flat.append(("text", text, None))
            want.append((role, [f for f in flat if f[1] != ""]))
        assert [(t.role, [tuple(p) for p in t.parts]) for t in got[c].turns] == want
        assert got[c].lost == "".join(p[1] for role, parts in want if role == "assistant" for p in parts if p[0] == "text")


def test_a_conversation_of_many_turns(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), chat.text_part(F.concat(F.lit("said <"), F.col("id").cast("string"))).alias("parts"))
    row = chat.format_chats(df).select(F.size(chat.read_turns(F.col("formatted"))).alias("n"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("lost")).first()
    assert row.n == 20_000 and row.lost == "".join(f"said <{i}" for i in range(1, 20_000, 2))


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_same_rows_as_duckdb(spark, data, name):
    assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(connect(data).sql(sql.SQL[name]).df())


def test_pipeline_against_brute_force(spark, data):
    import corpus_pipeline

    docs = pd.read_parquet(f"{data}/documents.parquet")
    bench = pd.read_parquet(f"{data}/benchmark.parquet")
    entries = {i: ledger_of(t) for i, t in zip(docs.doc_id, docs.text)}
    ok = []
    for i, t in zip(docs.doc_id, docs.text):
        n, chars, symbols, again, repeated = entries[i]
        lines = len([x for x in t.split("\n") if WORD.search(x)])
        if n >= 20 and 100 * repeated <= 30 * n and 5 * symbols <= n and 2 * again <= lines and 2 * n <= chars <= 20 * n and 5 * t.count("!") <= n:
            ok.append((i, t))
    fps = {i: plain_fingerprint(t) for i, t in ok}
    of = classes(set(fps.values()), 3)
    first = {}
    for i, f in sorted(fps.items()):
        first.setdefault(of[f], i)
    ok = [(i, t) for i, t in ok if first[of[fps[i]]] == i]
    dirty = {i for i, _, hit, _ in plain_contamination(ok, list(zip(bench.item_id, bench.text))) if hit}
    ok = [(i, t) for i, t in ok if i not in dirty]
    frame = spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id").isin([int(i) for i, _ in ok]))
    drawn = sorted(r.id for r in mixing.mixture(frame).where("kept").collect())
    got = corpus_pipeline.run(spark, data).toPandas().sort_values("doc_id")
    assert got.doc_id.tolist() == drawn
    assert got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
    assert len(corpus_pipeline.STAGES) == 5 and json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_every_query_on_empty_tables(spark, data, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name.startswith("op10_") else 0), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
