"""Whitening, conversation repair and language identification."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from ionloom.llm import conversations as cv
from ionloom.llm import language as lg
from ionloom.llm import q_corpus
from ionloom.llm import whitening as wh
from tests.llm.helpers import SF_DIR, awkward, awkward_rows, prose


def spectrum(values, seed=1):
    """A symmetric matrix in extended precision with given eigenvalues, and its eigenvectors."""
    rng = np.random.default_rng(seed)
    q = wh.orthonormal(np.linalg.qr(rng.standard_normal((len(values), len(values))))[0].astype(np.longdouble))
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 64, 48), 10.0 ** np.linspace(-6, 3, 48), np.r_[np.linspace(1, 40, 40), 41, 41 + 1e-9, 41 + 2e-9, 41 + 1e-7],
        np.r_[np.zeros(8), np.ones(8), np.linspace(2, 3, 24)], np.r_[np.ones(20), np.full(20, 1 + 1e-8)], np.ones(5), [3.0],
    ],
)
def test_refined_eigenvectors(values):
    a, _ = spectrum(values)
    found, x = wh.eigenvectors(a)
    assert np.abs(a @ x - x * found).max() <= 1e-17 * np.abs(a).max()
    assert np.abs(x.T @ x - np.eye(len(a))).max() <= 1e-17
    assert np.abs(found - np.sort(np.array(values, dtype=np.longdouble))[::-1]).max() <= 1e-16 * max(values)


def test_sub_solves_part_what_float32_cannot():
    a, q = spectrum(np.r_[np.linspace(1, 40, 40), 41, 41 + 1e-9])
    _, x = wh.eigenvectors(a)
    assert abs(abs(q[:, -1] @ x[:, 0]) - 1) < 1e-9
    assert abs(abs(q[:, -2] @ x[:, 1]) - 1) < 1e-9


def brute_whitening(vectors):
    """(x, n, S, eigenvalues falling, vectors, trace) of usable vectors."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, len(fit), fit.sum(axis=0), values[::-1], basis[:, ::-1]


def assert_whitened(rows, vectors):
    """`rows` by id, against numpy on the (id, vector) list."""
    x, n, sums, values, basis = brute_whitening([v for _, v in vectors])
    k = min(4, x.shape[1])
    want = (x - sums / n) @ basis[:, :k] / np.sqrt(values[:k])
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    sign = None
    for (i, _), line, own in zip(vectors, want, x, strict=True):
        mine = got[i]
        assert sorted(mine) == list(range(1, k + 1))
        have = np.array([mine[c]["whitened"] for c in sorted(mine)])
        sign = np.sign(have * line) if sign is None else sign
        assert np.allclose(have * sign, line, rtol=1e-8, atol=1e-8)
        assert {mine[c]["deviation"] for c in mine} == {sum(int(n * a - s) ** 2 for a, s in zip(own.tolist(), sums.tolist(), strict=True))}
        assert {mine[c]["n"] for c in mine} == {n}
        for c in mine:
            assert mine[c]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            assert mine[c]["identity_error"] < 1e-9


def test_whitening_query_equals_numpy(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert_whitened(q_corpus.op11_whitening(spark, SF_DIR).collect(), vectors)


def test_whitening_awkward_rows(spark):
    rng = random.Random(3)
    good = [(i, [rng.uniform(-2, 2) for _ in range(6)], "x") for i in range(40)]
    good += [(100, good[0][1], "copy"), (101, [-0.0, 1e-9, -1e-9, 3.0, 2.0, 1.0], None), (102, [20.0, -5.0, 1.0, 2.0, 3.0, 4.0], None)]
    bad = [(200, None, "x"), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (202, [math.nan] * 6, "x"), (203, [math.inf] * 6, "x"), (204, [], "x")]
    schema = "vec_id bigint, embedding array<double>, whitened string"
    rows = wh.whitened(spark.createDataFrame(good + bad, schema)).collect()
    assert {r["vec_id"] for r in rows} == {g[0] for g in good}
    assert_whitened(rows, [(g[0], g[1]) for g in good])
    empty = wh.whitened(spark.createDataFrame([], schema))
    assert empty.count() == 0 and "identity_error" in empty.columns
    # One distinct vector has no variance; int ids and short vectors keep their form; lengths go apart.
    same = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 5.0, 1.0])], "vec_id int, embedding array<float>")
    rows = wh.whitened(same).collect()
    assert len(rows) == 2 * 2 + 2 * 3
    flat = [r for r in rows if r["vec_id"] in (1, None)]
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)
    pair = {(r["vec_id"], r["component"]): r["whitened"] for r in rows if r["vec_id"] in (3, 4)}
    assert abs(pair[3, 1]) == pytest.approx(1) and pair[3, 1] == pytest.approx(-pair[4, 1])
    assert pair[3, 2] is None and pair[3, 3] is None


def test_moments_of_huge_entries_are_exact(spark):
    rows = [([10**15 + i, -(10**15) + i * i], ) for i in range(50)]
    m = wh.moments(spark.createDataFrame(rows, "x array<bigint>").repartition(5), 2)
    assert m.sums == [sum(r[0][k] for r in rows) for k in (0, 1)]
    for i, j in itertools.product((0, 1), repeat=2):
        assert m.scatter[i, j] == 50 * sum(r[0][i] * r[0][j] for r in rows) - m.sums[i] * m.sums[j]


# ---- conversation repair -------------------------------------------------------------------------


def brute_repair(rows):
    """Result for damaged (turn, role, text) rows of one conversation, in order, by a search over all states."""
    seen, letters, kinds = set(), [], [0, 0, 0]
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            kinds[fault] += 1
        letters.append((role[:1], fault in (0, 1), fault == 2))
    best = {"": (0, "", ())}  # by the last two initials' worth of state: '', s, u, a

    def better(table, state, way):
        if state not in table or way < table[state]:
            table[state] = way

    def inserted(table):
        for _ in range(2):
            for state, (cost, audit, lines) in list(table.items()):
                need = "a" if state == "u" else "u"
                better(table, need, (cost + 2, audit + "I", (*lines, f"{'user' if need == 'u' else 'assistant'}:")))
        return table

    for (_, role, text), (initial, must_go, truncated) in zip(rows, letters, strict=True):
        after = {}
        for state, (cost, audit, lines) in inserted(best).items():
            better(after, state, (cost + 3, audit + "D", lines))
            if must_go:
                continue
            need = "a" if state == "u" else "u"
            better(after, need, (cost + 2 + truncated, audit + "R", (*lines, f"{'user' if need == 'u' else 'assistant'}:{text}")))
            if initial == need or (initial == "s" and state == ""):
                better(after, initial, (cost + truncated, audit + "K", (*lines, f"{role}:{text}")))
        best = after
    ends = inserted(best)
    cost, audit, lines = min(ends[s] for s in ("", "a") if s in ends)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
    return (gaps, *kinds, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_conversation(rng, n):
    pool = ["Yes.", "No!", "What?", "maybe", " ", "", "Sure. ", "x", "Go.\n", "ok…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User"]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(pool) + (str(rng.randrange(50)) + "." if rng.random() < 0.5 else "")) for _ in range(n)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def repaired_rows(spark, conversations):
    rows = [(c, *r, False) for c, rows in conversations.items() for r in rows]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, gone boolean").repartition(7)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cv.repair(df).collect()}


@pytest.mark.parametrize("rows_in_chunk", [4096, 7])
def test_repair_equals_search(spark, rows_in_chunk, monkeypatch):
    """Short chunks make every conversation pass through the fix-up passes."""
    monkeypatch.setattr(cv, "CHUNK_ROWS", rows_in_chunk)
    rng = random.Random(5)
    talks = {i: random_conversation(rng, rng.choice([1, 2, 3, 5, 9, 30])) for i in range(60)}
    talks[None] = random_conversation(rng, 25)
    talks[1000] = random_conversation(rng, 400)
    talks[1001] = [(t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(300)]
    if rows_in_chunk == 7:
        talks = {k: talks[k] for k in (0, 3, 5, None, 1000, 1001)}
        cv_run = cv.chunked

        def chunked(batches):
            cv.CHUNK_ROWS = rows_in_chunk  # workers import the module anew
            return cv_run(batches)

        monkeypatch.setattr(cv, "chunked", chunked)
    got = repaired_rows(spark, talks)
    assert got == {k: brute_repair(ordered(v)) for k, v in talks.items()}


def test_chunks_converge_in_rank():
    """A chunk run from a speculative vector decides as one run from the true vector, once their ranks agree."""
    rng = random.Random(8)
    letters = "".join(rng.choice("suaxSUA-uaua") for _ in range(400))
    whole = cv.backward(letters, cv.END)
    far = cv.backward(letters, [0, 9, 3, 1])
    assert cv.rank(whole[0]) == cv.rank(far[0])
    audit, cost, _, _ = cv.trace(letters, cv.END, cv.START, True)
    assert cost == whole[0][cv.START]
    left = letters[:150]
    head, spent, state, _ = cv.trace(left, cv.rank(whole[150]), cv.START, False)
    tail, rest, _, _ = cv.trace(letters[150:], cv.END, state, True)
    assert head + tail == audit and spent + rest == cost


def test_copies_of_one_row_spread_and_count(spark):
    talks = {1: [(0, "user", "Hi.")] * 500, 2: [(None, "assistant", "So.")] * 3, 3: [(0, "user", "Hi.")]}
    got = repaired_rows(spark, talks)
    assert got == {k: brute_repair(v) for k, v in talks.items()}
    assert got[1][2] == 499


def test_damage_and_awkward_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, cost string, mark int"
    rows = [(c, t, r, x, "clash", 1) for c in (None, *range(30)) for t, r, x in [(None, None, None), (0, "user", "A b. C!"), (1, "assistant", "d?"), (1, "assistant", "d?"), (9, "system", "")]]
    rows.append((77, 3, "user", prose(2, 30_000) + ".", None, None))
    damaged = {}
    for c, t, role, text, *_ in rows:
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        damaged.setdefault(c, [])
        if harm == 0:
            continue
        text = "" if harm == 1 else "".join(x for x in text if x not in ".!?") if harm == 2 else text
        damaged[c] += [(t, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cv.repaired_conversations(df).collect()}
    assert got == {c: brute_repair(ordered(v)) for c, v in damaged.items()}
    assert cv.repaired_conversations(df.limit(0)).count() == 0
    lost = next(i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = cv.repaired_conversations(spark.createDataFrame([(lost, 0, "user", "Hi.", "", 0)], schema)).first()
    assert tuple(one[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# ---- language identification ---------------------------------------------------------------------


def test_gradients_by_differences():
    model = lg.new_model(["a", "b", "c"], 5)
    names = ["inputs", "hidden", "bias", "out", "shift"]
    model = model._replace(**{k: v.astype(np.float64) for k, v in zip(names, model.weights, strict=True)})
    data = np.frombuffer("hello world this is a tést of bytes".encode(), dtype=np.uint8)
    starts, lengths, target = np.array([0, 5, 9, 20]), np.array([14, 9, 9, 3]), np.array([0, 2, 1, 1])
    _, grads = lg.gradients(model, data, starts, lengths, target)
    rng = np.random.default_rng(0)
    for w, g in zip(model.weights, grads, strict=True):
        places = [tuple(rng.integers(0, s) for s in w.shape) for _ in range(6)]
        if w is model.inputs:
            places = [(k, int(data[j]), c) for k in (0, 1) for j in (3, 7) for c in (1, 6, 12)]
        for at in places:
            kept = w[at]
            w[at] = kept + 1e-6
            above = lg.gradients(model, data, starts, lengths, target)[0]
            w[at] = kept - 1e-6
            below = lg.gradients(model, data, starts, lengths, target)[0]
            w[at] = kept
            assert (above - below) / 2e-6 == pytest.approx(g[at], rel=1e-4, abs=1e-7)


def test_positions_do_not_depend_on_the_batch():
    import pyarrow as pa

    model = lg.new_model(["a", "b"], 6)
    texts = ["short", "", "a" * 300, prose(4, 80), None, "é" * 129]
    together = lg.pooled(model, pa.array(texts))
    for text, row in zip(texts, together, strict=True):
        assert np.allclose(lg.pooled(model, pa.array([text], pa.string()))[0], row, atol=1e-6)
        assert row.sum() == pytest.approx(1 if text else 0, abs=1e-5)


def test_language_query_on_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = q_corpus.op13_language(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        own = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in own["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif r["held_out"] and own["lang"] and len(own["text"]) >= 200:
            total += 1
            right += r["lang_pred"] == own["lang"]
    assert total > 100 and right / total > 0.98


def test_language_awkward_rows(spark):
    model = lg.train([b"aaa bab abba " * 20, b"zzz yzy zyyz " * 20], ["aa", "zz"], windows=64, epochs=6)
    df = awkward(spark).withColumnsRenamed({"n_words": "score"})
    rows = lg.predict(df, model).collect()
    assert len(rows) == len(awkward_rows())
    for r, own in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(awkward_rows(), key=lambda r: (r[0] is None, r[0])), strict=True):
        if own[0] is not None and not any(c.isalpha() for c in own[1] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    one = lg.predict(spark.createDataFrame([(1, "abba " * 90_000), (2, "zyyz zzz"), (3, "123")], "doc_id int, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in one.collect()} == {1: "aa", 2: "zz", 3: "und"}
    assert one.schema["doc_id"].dataType.simpleString() == "int"
    assert lg.learn(df.limit(0)) is None
    assert {r["lang_pred"] for r in lg.predict(df, None).collect()} == {"und"}
    assert lg.predict(df.limit(0), model).count() == 0


def test_runs_cover_every_byte(spark):
    model = lg.train([b"aaa bab abba " * 20, b"zzz yzy zyyz " * 20], ["aa", "zz"], windows=64, epochs=6)
    texts = {1: "abba bab aaa " * 8 + "zyyz zzz yzy " * 8, 2: "", 3: None, 4: "zzz" * 300}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = sorted((r["doc_id"], r["begin"], r["end"], r["lang"]) for r in lg.language_runs(df, model).collect())
    for i, text in texts.items():
        mine = [r for r in rows if r[0] == i]
        edges = [0, *(r[2] for r in mine)]
        assert [r[1] for r in mine] == edges[:-1] and edges[-1] == len(text or "")
    halves = [sum(e - b for i, b, e, lang in rows if i == 1 and lang == x and (b < 104) == (x == "aa")) for x in ("aa", "zz")]
    assert min(halves) > 70


def test_learning_sample_is_bounded(spark):
    rows = [(i, f"text {i}", "xx" if i % 50 else "yy") for i in range(6000)] + [(None, "t", None), (1, None, "xx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    drawn = lg.learning_rows(df, sample=40)
    by_lang = {x: sum(1 for l, _ in drawn if l == x) for x in ("xx", "yy")}
    assert 15 <= by_lang["xx"] <= 80 and 15 <= by_lang["yy"] <= 80
    assert all(zlib.crc32(t.removeprefix("text ").encode()) % 4 != 2 for _, t in drawn)
