"""Periodic runs, nearest neighbours and repaired conversations against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import conversation_repair, periodic_runs, queries, vector_graph

from .conftest import ODD, prose, same_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- periodic runs


def runs_by_period(words, least=24, times=3):
    """Runs found period by period, each with its smallest period."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, times * q):
                run = words[start : start + length]
                if not any(run[p:] == run[:-p] for p in range(1, q)):
                    found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    g, h = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if h:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def run_report(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = runs_by_period(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    rest = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(rest))


def test_runs_equal_those_found_period_by_period():
    draw = random.Random(1)
    for least, times in ((24, 3), (6, 3), (3, 3), (50, 4)):
        for _ in range(60):
            texts = []
            for _ in range(draw.randint(0, 4)):
                words = [draw.randrange(draw.choice([1, 2, 3, 8])) for _ in range(draw.randint(0, 150))]
                for _ in range(draw.randint(0, 3) if words else 0):
                    a = draw.randrange(len(words))
                    p = draw.randint(1, max(1, (len(words) - a) // 3))
                    for i in range(a, draw.randint(a, len(words))):
                        words[i] = words[a + (i - a) % p]
                texts.append(words)
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=int)])
            got = periodic_runs.find_runs(np.array([w for t in texts for w in t], np.int64), first, least, times)
            expected = [(int(first[i]) + s, n, p) for i, t in enumerate(texts) for s, n, p in runs_by_period(t, least, times)]
            assert list(zip(*(x.tolist() for x in got))) == expected


def test_words_of_runs_are_those_between_blanks():
    texts = ["", "  a\x1fb\x0bc\n ", "\xa0 d", "\t", "e\x00f\x85g h", "x"]
    words, first = periodic_runs.split_words(pa.array([t.encode() for t in texts], pa.large_binary()))
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip(first, first[1:])] == [WORD.findall(t) for t in texts]


def test_periodic_runs_query(spark, folder_of, docs_of, small_docs):
    line = prose(3, 9)
    more = [(300 + i, t) for i, t in enumerate([" ".join([line] * 7) + " end", "a " * 24, "a " * 23, ("a b " * 20 + "c ") * 5, f"{line}\n" * 3 + prose(8, 40)])]
    rows = ODD + small_docs + more
    assert sum(i is not None and bool(t) and zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows) > 10
    got = queries.op11_periodic_runs(spark, folder_of(documents=docs_of(rows)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    slow = {i for i, t in rows if len(WORD.findall(t or "")) > 4000}  # for brute force
    assert slow and None not in slow
    kept = got.filter(~F.coalesce(F.col("doc_id").isin(list(slow)), F.lit(False))).collect()
    same_rows(kept, [run_report(i, t) for i, t in rows if i not in slow])
    assert got.count() == len(rows) and queries.op11_periodic_runs(spark, folder_of(documents=docs_of([]))).count() == 0


def test_collapsed_texts_and_clashing_columns(spark, docs_of):
    docs = docs_of([(1, "start " + "la li lu " * 10 + "end"), (2, None)]).withColumnRenamed("found", "runs")
    frame, names = periodic_runs.collapse_runs(docs, docs.columns)
    assert len(set(map(str.lower, frame.columns))) == len(frame.columns)
    rows = {r["doc_id"]: r for r in frame.collect()}
    assert rows[1][names["collapsed"]] == "start la li lu end" and rows[2][names["collapsed"]] == "" and rows[2][names["runs"]] == []
    assert [tuple(r) for r in rows[1][names["runs"]]] == [(1, 30, 3)] and rows[1][names["n_words"]] == 32
    planted_docs = periodic_runs.repeat_words(docs.withColumnsRenamed({"lang": "h", "source": "words"}))
    assert planted_docs.columns == ["doc_id", "text", "h", "words", "n_chars", "fingerprint", "runs", "n_words"] and planted_docs.count() == 2


# --- nearest neighbours


VECTORS = "vec_id long, embedding array<float>, label int, shard string, row string, query string"


@pytest.fixture(scope="module")
def vectors_of(spark):
    return lambda rows: spark.createDataFrame([(i, v, None, "clash", "clash", "clash") for i, v in rows], VECTORS)


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def exact_neighbours(rows, k=10):
    """(query, its row number, [(distance, id is missing, id)]) for every query, over all other rows."""
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    rows = [(i, v) for i, v in rows if usable(v)]
    for n, (i, v) in enumerate(rows):
        if i is not None and i % 100 == 0:
            same = [m for m, (_, w) in enumerate(rows) if m != n and len(w) == len(v)]
            distance = np.sqrt(((np.array([rows[m][1] for m in same]).reshape(len(same), len(v)) - np.array(v)) ** 2).sum(axis=1))
            others = [(d, rows[m][0] is None, rows[m][0]) for d, m in zip(distance.tolist(), same)]
            yield i, sorted(others, key=lambda x: (x[0], x[1], x[2] or 0))[:k]


def found_neighbours(frame):
    results = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        results[r["query_id"]].append(r)
    return results


def test_recall_of_the_vector_query(spark, folder_of, vectors_of, small):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 64)) * 3
    rows = [(i, (centres[i % 12] + draw.normal(size=64)).tolist()) for i in range(10_001)]
    exact = dict(exact_neighbours(rows))
    got = found_neighbours(queries.op12_vector_graph(spark, folder_of(embeddings=vectors_of(rows))))
    assert got.keys() == exact.keys()
    hits = sum(len({r["vec_id"] for r in got[q]} & {j for _, _, j in near}) for q, near in exact.items())
    assert hits >= 0.95 * 10 * len(exact)
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 11)) and q not in {r["vec_id"] for r in found}
        assert all(abs(r["score"] - np.linalg.norm(vectors[q] - vectors[r["vec_id"]])) < 1e-12 for r in found)
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)


def test_vectors_that_are_odd_equal_or_few(spark, folder_of, vectors_of):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [1.0, 2.0]), (200, None), (300, []), (400, [0.0, -0.0]), (500, [1.0, nan]), (600, [inf, 1.0]),
            (700, [None, 1.0]), (800, [1.0, 2.0, 3.0]), (900, [1.0, 2.0, 4.0]), (None, [1.0, 2.5]), (1, [-0.0, 2.0]), (2, [0.0, 2.0]), (1000, [7.0])]
    rows += [(10_000 + i, [5.0, 5.0]) for i in range(3000)] + [(20_000, [5.0, 5.0])]
    got = queries.op12_vector_graph(spark, folder_of(embeddings=vectors_of(rows))).collect()
    expected = [(q, rank, j, d) for q, near in exact_neighbours(rows) for rank, (d, _, j) in enumerate(near, 1)]
    same_rows([(r[0], r[1], r[2], round(r[3], 9)) for r in got], [(q, rank, j, round(d, 9)) for q, rank, j, d in expected])
    assert queries.op12_vector_graph(spark, folder_of(embeddings=vectors_of([]))).count() == 0
    assert queries.op12_vector_graph(spark, folder_of(embeddings=vectors_of([(100, None), (1, [0.0])]))).count() == 0


def test_every_row_is_in_one_shard(spark, vectors_of):
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(1000)] + [(5, [1.0] * 8)] * 500
    index = vector_graph.build_index(vectors_of(rows), shard_rows=256)
    shards = index.collect()
    assert len(shards) == 6 and max(len(r["ids"]) for r in shards) < 300
    same_rows([(i,) for r in shards for i in r["ids"]], [(i,) for i, _ in rows])
    for r in shards:  # a graph: links lead to nodes of the layer, every node can be reached from the first
        for size, layer in zip(r["layer_sizes"], r["layers"]):
            links = np.frombuffer(layer, "i4").reshape(size, -1)
            seen, front = {0}, [0]
            while front:
                front = [j for i in front for j in links[i].tolist() if j >= 0 and j not in seen and not seen.add(j)]
            assert links.max(initial=-1) < size and len(seen) == size


def test_search_without_own_rows_and_in_doubles(spark):
    draw = np.random.default_rng(7)
    rows = [(i, (draw.normal(size=16) * 1e-3 + 1e6).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    index = vector_graph.build_index(frame, "id", "v", shard_rows=200)
    got = found_neighbours(vector_graph.search_index(index, frame.filter("id < 20"), 5, "id", "v", exclude_own=False))
    for i in range(20):
        distance = sorted((float(np.linalg.norm(np.array(rows[i][1]) - np.array(v))), j) for j, v in rows)[:5]
        assert [r["vec_id"] for r in got[i]] == [j for _, j in distance] and got[i][0]["score"] == 0


# --- conversations

TURNS = "conv_id long, turn long, role string, text string, place string, piece string, m string"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(turns):
    """(cost, audit, repaired lines), from the last turn to the first, with the edits as a string so that ties are ASCII-least."""

    def join(cost, edit, line, rest):
        return cost + rest[0], edit + rest[1], (line, *rest[2]) if line else rest[2]

    table = {}
    for i in range(len(turns), -1, -1):
        for last in FOLLOWS:
            options = [(0, "", ())] if i == len(turns) and last in ("", "a") else []
            if i < len(turns):
                role, text, gone, cut = turns[i]
                options.append(join(2, "D", None, table[i + 1, last]))
                if not gone:
                    if role[:1] and role[:1] in FOLLOWS[last]:
                        options.append(join(5 * cut, "K", (role, text), table[i + 1, role[0]]))
                    new = "assistant" if last == "u" else "user"
                    options.append(join(1 + 5 * cut, "R", (new, text), table[i + 1, new[0]]))
            table[i, last] = min(options, default=(math.inf, "", ()))
        for _ in range(3):
            for last in FOLLOWS:
                new = "assistant" if last == "u" else "user"
                table[i, last] = min(table[i, last], join(5, "I", (new, ""), table[i, new[0]]))
    return table[0, ""]


def conversation_report(rows):
    """What the query says of (conv_id, turn, role, text) rows."""
    by_conv = defaultdict(list)
    text_of = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        own = by_conv[conv]
        m = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        own += [(turn, "user" if m == 4 else role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            solid = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            turns.append((role, text, fault in (0, 1), fault == 2))
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(tuple(turns))
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        yield conv, gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def random_turns(seed, n):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "So it goes. ", "and then", "", " \n", "end.\t", "a.b", "\xa0", None, prose(seed, 5) + "."]
    return [(draw.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]), draw.choice([*texts, prose(draw.randrange(10**6), 3) + "."])) for _ in range(n)]


@pytest.fixture(scope="module")
def turns_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], TURNS)


def test_walk_is_the_cheapest_and_least(spark):
    draw = random.Random(3)
    for n in [0, 1, 2, 3, 4, 5, 9, 16, 17, 50] * 30:
        letters = "".join(draw.choice("uausaoUASOx") for _ in range(n))
        turns = tuple(({"o": "tool"}.get(c.lower(), c.lower()), str(i), c == "x", c.isupper()) for i, c in enumerate(letters))
        cost, audit, _ = cheapest(turns)
        cut = draw.randint(0, n)  # two pieces give what one gives
        behind = conversation_repair.costs_of(letters[cut:], conversation_repair._END)
        first, state = conversation_repair.walk(letters[:cut], behind, (0,))[0]
        second, state = conversation_repair.walk(letters[cut:], conversation_repair._END, (state,))[state]
        assert conversation_repair.costs_of(letters, conversation_repair._END)[0] == cost
        assert first + second + conversation_repair.closing(state)[0] == audit
        costs = conversation_repair.piece_costs(letters[:cut])
        assert min(costs[b][0] + behind[b] for b in range(4)) == cost


def test_repair_query(spark, folder_of, turns_of, small, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    top = max(r[0] for r in rows) + 1
    draw = random.Random(8)
    for i in range(60):
        turns = random_turns(i, draw.choice([1, 2, 3, 6, 12]))
        rows += [(top + i, draw.choice([t, t, t, t + 3, None, -t]), role, text) for t, (role, text) in enumerate(turns)]
    rows += [(None, t, role, text) for t, (role, text) in enumerate(random_turns(99, 9))]
    rows += [(top + 70, 4, "user", "Same.")] * 5 + [(top + 71, None, "user", "Odd")] * 2 + [(top + 72, t, role, text) for t, (role, text) in enumerate(random_turns(5, 300))]
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    expected = list(conversation_report(rows))
    assert any(r[7] == "" for r in expected) and set("".join(r[7] for r in expected)) == {"D", "K", "R"}  # deleting a neighbour costs less than an insertion
    folder = folder_of(conversations=turns_of(rows))
    for bits in (conversation_repair.PIECE_BITS, 2):  # pieces of four turns give the same
        monkeypatch.setattr(conversation_repair, "PIECE_BITS", bits)
        got = queries.op13_conversation_repair(spark, folder)
        assert got.columns == columns
        same_rows(got.collect(), expected)
    assert queries.op13_conversation_repair(spark, folder_of(conversations=turns_of([]))).count() == 0


def test_repaired_turns(spark, turns_of):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."),
        (2, 0, "user", "Cut off"), (2, 1, "assistant", "Fine."), (2, 2, "user", "Why?"),
        (3, 0, "system", "Be kind."), (3, 1, "user", "Why?"), (3, 2, "assistant", "So."), (3, 3, "assistant", "So it is."), (3, 4, "user", "Yes."),
        (3, 6, "assistant", "Good."),
    ]
    turns, report = conversation_repair.repair(turns_of(rows))
    got = turns.orderBy("conversation", "piece", "position").select("conversation", "edit", "turn", "role", "text").collect()
    assert [tuple(r) for r in got] == [
        (1, "R", 0, "user", "Be kind."), (1, "K", 1, "assistant", "Hello."), (2, "R", 1, "user", "Fine."), (2, "R", 2, "assistant", "Why?"),
        (3, "K", 0, "system", "Be kind."), (3, "K", 1, "user", "Why?"), (3, "K", 3, "assistant", "So it is."), (3, "K", 4, "user", "Yes."),
        (3, "K", 6, "assistant", "Good."),
    ]
    rows = {r["conversation"]: tuple(r)[1:] for r in report.collect()}
    assert rows == {1: (0, 0, 1, 0, 2, 3, "RKD"), 2: (0, 0, 0, 1, 0, 4, "DRR"), 3: (1, 0, 0, 0, 1, 2, "KKDKKK")}


def test_walks_by_hand():
    assert conversation_repair.walk("su", conversation_repair._END, (0,))[0] == ("RR", 3)
    assert conversation_repair.walk("uaUA", conversation_repair._END, (0,))[0] == ("KKDD", 3)
    assert [a for a in conversation_repair.actions("u", "KI", 0)] == [("K", 0, None), ("I", 1, "assistant")]
