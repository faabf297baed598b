"""SimHash groups, their index and components, and repeated passages, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from shelfwise.llm import compact_windows, gray_simhash, queries
from shelfwise.llm.components import components
from shelfwise.llm.words import mix

from .conftest import ODD, prose, same_rows


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def simhash_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups_by_hand(rows):
    prints = {t: simhash_by_hand(t) for t in {t for _, t in rows}}
    codes = sorted(set(prints.values()))
    links = [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 3]
    root = roots(codes, links)
    lowest = {}
    for i, t in rows:
        if i is not None:
            lowest[root[prints[t]]] = min(i, lowest.get(root[prints[t]], i))
    return [(i, f"{prints[t]:016x}", lowest.get(root[prints[t]])) for i, t in rows]


def variants(seed, n, words=200):
    """A text and copies with a word changed each, some of which are linked to others alone."""
    text = prose(seed, words).split()
    for i in range(n):
        text = list(text)
        text[random.Random(i).randrange(len(text))] = f"changed{i}"
        yield " ".join(text)


def test_simhash_groups_equal_brute_force(spark, docs_of, folder_of, small_docs):
    rows = ODD + [(1000 + i, t) for i, t in small_docs] + [(2000 + i, t) for i, t in enumerate(variants(3, 60))]
    rows += [(3000 + i, rows[20][1]) for i in range(30)]
    got = queries.op7_gray_simhash(spark, folder_of(documents=docs_of(rows)))
    same_rows(got.collect(), groups_by_hand(rows))


@pytest.mark.parametrize("limit, most", [(3, 4096), (3, 48), (1, 8)])
def test_links_equal_all_pairs_however_small_the_groups(spark, limit, most):
    draw = random.Random(limit * 100 + most)
    centres = [draw.getrandbits(64) for _ in range(6)]
    codes = {0, 1, 3, 7, 15, (1 << 64) - 1, *centres}
    codes |= {draw.choice(centres) ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(1, 5))) & (1 << 64) - 1 for _ in range(200)}
    codes |= {centres[0] ^ sum(1 << b for b in draw.sample(range(12), 3)) for _ in range(120)}
    signed = {c: c - (1 << 64) if c >> 63 else c for c in codes}
    frame = spark.createDataFrame([(c,) for c in signed.values()], "code long")
    links = gray_simhash.near_links(frame, limit, most).collect()
    unsigned = [tuple(x % (1 << 64) for x in r) for r in links]
    assert all(a != b for a, b in unsigned)
    ordered = sorted(codes)
    every = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= limit]
    assert roots(codes, unsigned) == roots(codes, every)


def test_gray_index_finds_all_pairs():
    draw = np.random.default_rng(5)
    for n in (2, 3, 17, 128, 129, 700):
        codes = np.unique(draw.integers(0, 1 << 12, n).astype(np.uint64) << np.uint64(20))
        index = gray_simhash.GrayIndex(codes)
        assert (np.sort(index.codes) == codes).all() and (np.diff(gray_simhash.gray_rank(index.codes).astype(float)) >= 0).all()
        got = {(int(i), int(j)) for a, b in index.pairs(3) for i, j in zip(a, b)}
        c = index.codes
        assert got == {(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if int(c[i] ^ c[j]).bit_count() <= 3}


def test_components(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(400, 450)] + [(7, 7)]
    links += [(draw.randrange(1000, 1400), draw.randrange(1000, 1400)) for _ in range(250)] + [(101, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert got == roots({x for link in links for x in link}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(docs_of):
    rows = ODD + [(2000 + i, t) for i, t in enumerate(variants(3, 30))] + [(None, "lone text"), (None, "lone text"), (1500, "lone text again")]
    docs = docs_of(rows)
    kept = gray_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {}
    for (i, text), (_, _, group) in zip(rows, groups_by_hand(rows)):
        groups.setdefault(("none", simhash_by_hand(text)) if group is None else group, set()).add(i)
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(str(min(g, key=lambda i: (i is None, i or 0))) for g in groups.values())


def windows_by_hand(shingles, function, least):
    v = [0 if s == 0 else max(1, int(mix(np.array([s ^ ((function + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1)], np.uint64))[0])) for s in shingles]
    out = []
    for c, x in enumerate(v):
        left = right = c
        while x and left > 0 and v[left - 1] > x:
            left -= 1
        while x and right + 1 < len(v) and v[right + 1] >= x:
            right += 1
        if x and right - left + 1 >= least:
            out.append((left, c, right))
    return out


@pytest.mark.parametrize("least", [1, 2, 5, 9, 46])
def test_compact_windows_equal_brute_force(least):
    draw = random.Random(least)
    for _ in range(25):
        shingles = [draw.choice([0, *range(1, 40)]) if draw.random() < 0.3 else draw.getrandbits(60) for _ in range(draw.randint(1, 120))]
        got = compact_windows.compact_windows(np.array(shingles, np.uint64), 2, least)
        assert list(zip(*(x.tolist() for x in got[1:]))) == windows_by_hand(shingles, 2, least)


def test_windows_that_overlap_with_enough_functions():
    draw = random.Random(8)
    for _ in range(30):
        windows = []
        for _ in range(draw.randint(1, 25)):
            left = draw.randrange(150)
            right = left + draw.randrange(9, 60)
            windows.append((draw.randrange(4), left, draw.randint(left, right), right))
        f, left, c, right = (np.array(x) for x in zip(*windows))
        got = compact_windows.met_enough(compact_windows._pack(f, left, c, right), 10, 2)
        over = lambda x, y: min(x[3], y[3]) - max(x[1], y[1]) + 1 >= 10
        assert got.tolist() == [len({y[0] for y in windows if over(x, y)}) >= 2 for x in windows]


def test_every_passage_lies_in_one_window():
    shingles = np.array([random.Random(1).getrandbits(60) for _ in range(40)], np.uint64)
    windows = list(zip(*(x.tolist() for x in compact_windows.compact_windows(shingles, 0, 7)[1:])))
    for i in range(40):
        for j in range(i + 6, 40):
            assert sum(left <= i <= c <= j <= right for left, c, right in windows) == 1


def planted():
    passage, other = prose(77, 80), prose(78, 60)
    near = passage.split()
    near[40] = "different"
    rows = [(i, f"{prose(300 + i, 90)} {passage} {prose(400 + i, 70)}") for i in range(10)]
    rows += [(20, f"{prose(320, 200)}\n{' '.join(near)}"), (21, f"{other.upper()} {prose(321, 90)}"), (22, f"{prose(322, 90)} {other}")]
    rows += [(30, prose(330, 90)), (31, prose(330, 90)), (32, prose(332, 40)), (33, prose(332, 40))]  # copies; too short for a passage
    rows += [(40 + i, prose(340 + i, 300)) for i in range(20)]  # clean
    rows += [(70, f"{prose(370, 60)} {' '.join(passage.split()[:40])} {prose(371, 60)}")]  # less than 50 words in common
    rows += [(80, f"{prose(380, 70)} {prose(381, 30)} {prose(380, 70)}")]  # repeats itself alone
    return rows


def test_repeated_passages(spark, docs_of):
    rows = planted() + ODD
    got = compact_windows.repeated_passages(docs_of(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    expected = {*range(10), 20, 21, 22, 30, 31, 10, 13}
    assert {i for i in by if i is not None} == expected
    for i in range(10):
        (r,) = by[i]
        assert r["start"] <= 90 and r["stop"] >= 170 and r["stop"] - r["start"] < 100
        assert r["partner_id"] in {*range(10), 20} - {i} and r["class_id"] == 0
    assert by[20][0]["class_id"] == 0 and 0.8 <= by[20][0]["similarity"] < 1
    assert by[21][0]["partner_id"] == 22 and by[22][0]["class_id"] == 21
    assert [(r["start"], r["stop"], r["partner_id"]) for r in by[30] + by[31]] == [(0, 90, 31), (0, 90, 30)]
    assert by[10][0]["partner_id"] == 13 and (by[10][0]["start"], by[10][0]["stop"]) == (0, 20_000)


def changed_copies():
    """(a, b, words of the passage in a, in b): copies with words put in, left out or replaced, amid 60 words of their own."""
    draw, out = random.Random(21), []
    for case in range(120):
        words = prose(5000 + case, draw.randint(60, 200)).split()
        copy, at = list(words), draw.randrange(10, len(words) - 10)
        kind, n = ("in", "out", "replaced", "both")[case % 4], draw.randint(1, max(2, len(words) // 10))
        if kind in ("out", "both"):
            del copy[at : at + n]
        if kind in ("in", "both"):
            copy[at:at] = [f"put{case}x{k}" for k in range(n)]
        if kind == "replaced":
            copy[at] = f"other{case}"
        pad = [[f"pad{case}x{k}x{j}" for j in range(60)] for k in range(4)]
        out.append((pad[0] + words + pad[1], pad[2] + copy + pad[3], len(words), len(copy)))
    return out


def test_passages_with_words_put_in_or_left_out_are_found():
    """Whatever the sides' lengths: each pair whose whole passages reach the similarity is found, and whole."""
    numbers = {}
    as_shingles = lambda w: np.array([numbers.setdefault(tuple(w[k : k + 5]), len(numbers) + 1) for k in range(len(w) - 4)], np.uint64)
    unequal = 0
    for words, copy, n, m in changed_copies():
        a, b = as_shingles(words), as_shingles(copy)
        mine, theirs = set(a[60 : 60 + n - 4].tolist()), set(b[60 : 60 + m - 4].tolist())
        jaccard = len(mine & theirs) / len(mine | theirs)
        if jaccard < 0.8 or m < 50:
            continue
        unequal += abs(n - m) >= 5 and jaccard < 0.9
        shared = [i for i in range(60, 60 + n - 4) if int(a[i]) in theirs]
        for at in (shared[0], shared[len(shared) // 2], shared[-1]):
            there = int(np.flatnonzero(b == a[at])[0])
            got = compact_windows.near_passages(a, b, np.unique(b), np.array([at]), np.array([there]), 46, 0.8)
            assert len(got) == 1, (n, m, jaccard)
            a1, a2, b1, b2, similarity = got[0]
            assert (a1, a2) == (60, 60 + n - 5) and (b1, b2) == (60, 60 + m - 5)
            assert similarity == pytest.approx(jaccard)
    assert unequal >= 10


def test_a_passage_is_cut_back_until_it_is_similar():
    """70 equal shingles, then every second one differs in both: the run of both is below the similarity, the equal part is not."""
    equal = list(range(1, 71))
    a = np.array(equal + [x for k in range(25) for x in (100 + k, 1000 + k)], np.uint64)
    b = np.array(equal + [x for k in range(25) for x in (100 + k, 2000 + k)], np.uint64)
    (got,) = compact_windows.near_passages(a, b, np.unique(b), np.array([30]), np.array([30]), 46, 0.8)
    assert got[0] == got[2] == 0 and got[1] >= 69 and got[4] >= 0.8


def test_a_passage_with_words_put_in_is_reported(docs_of):
    rows = []
    for i in range(12):
        words = prose(7000 + i, 70).split()
        longer = words[:35] + [f"new{i}x{k}" for k in range(5)] + words[35:]
        rows += [(2 * i, f"{prose(7100 + i, 60)} {' '.join(words)} {prose(7200 + i, 60)}")]
        rows += [(2 * i + 1, f"{prose(7300 + i, 60)} {' '.join(longer)} {prose(7400 + i, 60)}")]
    got = compact_windows.repeated_passages(docs_of(rows)).collect()
    assert len(got) >= 18 and all(r["partner_id"] == r["doc_id"] ^ 1 and 0.8 <= r["similarity"] < 0.85 for r in got)


def test_a_common_line_does_not_hide_a_passage_around_it(docs_of):
    line, rows = prose(999, 12), []
    for i in range(300):
        middle = prose(1000 + i // 2, 45) if i < 20 else prose(1000 + i, 45)  # pairs share the line and 45 words
        rows.append((i, f"{prose(2000 + i, 40)} {line} {middle} {prose(3000 + i, 40)}"))
    got = compact_windows.repeated_passages(docs_of(rows)).collect()
    assert {r["doc_id"]: r["partner_id"] for r in got} == {i: i ^ 1 for i in range(20)}


@pytest.mark.parametrize("common", [30, 40, 45])
def test_recall_amid_a_line_that_all_documents_hold(spark, docs_of, folder_of, common):
    """Pairs that share 55 or 56 words which no other document has as a whole, most of them in a line that all have."""
    line, rows, draw = prose(999, common), [], random.Random(common)
    for i in range(0, 240, 2):
        own = prose(1000 + i, 55 + i % 4 // 2 - common).split()
        cut = draw.randint(0, len(own))
        passage = " ".join([*own[:cut], line, *own[cut:]])
        rows += [(i + k, f"{prose(3000 + i + k, 40)} {passage} {prose(4000 + i + k, 40)}") for k in range(2)]
    got = queries.op8_compact_windows(spark, folder_of(documents=docs_of(rows))).collect()
    partners = {(r["doc_id"], r["partner_id"]) for r in got if r["stop"] - r["start"] >= 50}
    assert all(r["similarity"] >= 0.8 for r in got)
    assert sum((i, i ^ 1) in partners for i in range(240)) >= 0.95 * 240


@pytest.mark.parametrize("replaced, least", [(1, 0.95), (2, 0.9)])
def test_recall_of_passages_with_replaced_words(spark, docs_of, folder_of, replaced, least):
    """Pairs with a passage of 60 words, of which the copy has one or two others: similarities from 0.8 to 0.92."""
    rows, expected, draw = [], 0, random.Random(replaced)
    for i in range(0, 300, 2):
        words = prose(11_000 + i, 60).split()
        copy = list(words)
        for k, at in enumerate(draw.sample(range(60), replaced)):
            copy[at] = f"other{i}x{k}"
        mine, theirs = ({tuple(w[k : k + 5]) for k in range(56)} for w in (words, copy))
        expected += len(mine & theirs) >= 0.8 * len(mine | theirs)
        rows += [(i + k, f"{prose(13_000 + i + k, 40)} {' '.join(w)} {prose(15_000 + i + k, 40)}") for k, w in enumerate((words, copy))]
    got = queries.op8_compact_windows(spark, folder_of(documents=docs_of(rows))).collect()
    found = {r["doc_id"] // 2 for r in got}
    assert all(r["partner_id"] == r["doc_id"] ^ 1 for r in got) and len(found) >= least * expected


def test_passages_on_the_test_table(spark, small, small_docs):
    """Every exact run of 50 words that two documents share is found; every reported similarity holds."""
    got = queries.op8_compact_windows(spark, small).collect()
    reported = {r["doc_id"] for r in got}
    seen, sharing = {}, set()
    for i, text in small_docs:
        words = text.encode().lower().split()
        for run in {b" ".join(words[k : k + 50]) for k in range(len(words) - 49)}:
            if run in seen:
                sharing |= {i, seen[run]}
            seen.setdefault(run, i)
    assert sharing and sharing <= reported
    texts = dict(small_docs)
    for r in got:
        words = texts[r["doc_id"]].encode().lower().split()[r["start"] : r["stop"]]
        other = texts[r["partner_id"]].encode().lower().split()
        mine, theirs = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other))
        assert len(words) >= 50 and len(mine & theirs) >= 0.7 * len(mine)


@pytest.mark.parametrize("query", ["op7_gray_simhash", "op8_compact_windows"])
def test_empty_tables(spark, docs_of, folder_of, query):
    assert queries.QUERIES[query](spark, folder_of(documents=docs_of([]))).count() == 0
