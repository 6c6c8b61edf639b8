"""Repeated passages: chains against quadratic chaining, planted passages, clean texts."""

import numpy as np

from tidemark.llm import substrings as S
from tidemark.llm.common import shuffles_freed


def say(rng, n, words=4000):
    return [f"w{i}" for i in rng.integers(0, words, n)]


def test_chain_score_equals_quadratic_chaining():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (rng.integers(1, 40), 2))})
        score = []
        for i, (a, b) in enumerate(m):
            best = max(((score[j] + S.COST * sum(m[j]), j) for j in range(i) if m[j][0] < a and m[j][1] < b), default=None)
            s = S.K
            if best is not None:
                da, db = a - m[best[1]][0], b - m[best[1]][1]
                gain = S.K + best[0] - S.COST * (a + b)
                if max(da, db) <= S.GAP + S.K and gain > s:
                    s = gain
            score.append(s)
        paths = S.chain(m)
        top = max(paths, key=lambda p: len(p))
        assert sorted(x for p in paths for x in p) == m
        assert all(p[i][0] < p[i + 1][0] and p[i][1] < p[i + 1][1] for p in paths for i in range(len(p) - 1)) and top
        first = paths[0]
        got = S.K + sum(S.K - S.COST * (sum(x) - sum(y)) for y, x in zip(first, first[1:], strict=False))
        assert abs(got - max(score)) < 1e-6


def test_seeds_in_every_stretch():
    rng = np.random.default_rng(1)
    words = [w.encode() for w in say(rng, 500, 30)]
    hashes, at = S.seeds(words)
    assert np.diff(at).max() <= S.W and at[0] < S.W and at[-1] >= len(words) - S.K + 1 - S.W
    more = [w.encode() for w in say(rng, 33)] + words[100:160]
    assert set(S.seeds(more)[0].tolist()) & set(hashes.tolist())


def test_run_hashes():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    for n in (1, 2, 3, 4, 7, 36):
        want = []
        for i in range(61 - n):
            h = 0
            for v in x[i : i + n].tolist():
                h = (h * int(S._BASE) + v) % (1 << 64)
            want.append(h)
        assert S.runs(x, n).tolist() == want


def test_words_are_told_apart_wherever_they_stand(monkeypatch):
    rng = np.random.default_rng(17)
    words = ["".join(rng.choice(list("abcé"), int(rng.integers(1, 9)))).encode() for _ in range(3000)] + [b"a" * 3000, b"a" * 3001]
    data = b"  " + b"   ".join(words) + b" "
    for size in (1 << 20, 100):
        monkeypatch.setattr(S, "CHUNK", size)
        hashes, starts = S.words_in(data)
        assert [data[s:].split(b" ", 1)[0] for s in starts.tolist()] == words
        by = {}
        for w, h in zip(words, hashes.tolist(), strict=True):
            by.setdefault(w, set()).add(h)
        assert all(len(h) == 1 for h in by.values()) and len(set(hashes.tolist())) == len(by)
    assert len(S.words_in(b"")[0]) == len(S.words_in(b"   ")[0]) == 0
    short = S.Texts([b"", b"one two", b" ", b"one two three"], 3)
    assert short.rows.tolist() == [3] and short.size.tolist() == [3]


def test_texts_on_end_equal_texts_alone():
    rng = np.random.default_rng(11)
    parts = [" ".join(say(rng, n, 40)).encode() for n in (50, 51, 300, 64)]
    t = S.Texts(parts)
    hashes, text, at = t.seeds()
    contexts = t.contexts(text, at)
    for i, p in enumerate(parts):
        one = S.Texts([p])
        assert t.keys[i] == one.keys[0] == S.text_key(p.split()) and len(one.words(0)) == len(p.split())
        h, x, a = one.seeds()
        assert hashes[text == i].tolist() == h.tolist() and (at[text == i] - t.first[i]).tolist() == (a - one.first[0]).tolist()
        assert all((c[text == i] == d).all() for c, d in zip(contexts, one.contexts(x, a), strict=True))


def test_parts_of_a_passage_do_not_hide_it(spark):
    """Texts whose ids come first and last hold the halves, and two others the whole."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        p = say(rng, 56, 10**6)
        for part in (p[:34], p[20:], p, p, p[:40], p[12:]):
            rows.append(say(rng, 30, 10**6) + part + say(rng, 30, 10**6))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id for r in S.repeated(d).collect()}
    assert got == {6 * g + k for g in range(12) for k in (2, 3)}


def test_planted_passages(spark):
    rng = np.random.default_rng(2)
    passage, fuzzy, short = say(rng, 60), say(rng, 120), say(rng, 40)
    rows = {}
    for i in range(40):  # clean, but for words
        rows[i] = say(rng, int(rng.integers(0, 300)))
    for i in (50, 51, 52, 53):
        rows[i] = say(rng, int(rng.integers(10, 200))) + passage + say(rng, int(rng.integers(0, 200)))
    for i in (60, 61):
        edited = [w if j % 29 or i == 60 else "edit" for j, w in enumerate(fuzzy)]
        rows[i] = say(rng, 90) + (edited if i == 60 else edited[:70] + edited[73:]) + say(rng, 20)
    for i in (70, 71):
        rows[i] = say(rng, 50) + short + say(rng, 50)
    rows[80] = rows[81] = rows[82] = say(rng, 77)
    rows[90] = say(rng, 30) + rows[53][:40] + passage[:10]  # too little of it
    texts = {i: " ".join(w).replace("w1 ", "W1, ") for i, w in rows.items()}
    d = spark.createDataFrame([*((i, t, "n") for i, t in texts.items()), (100, None, "n"), (None, texts[80], "n"), (3, texts[3], "n")], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in S.repeated(d).collect()}
    want = {50, 51, 52, 53, 60, 61, 80, 81, 82, None} | ({3} if len(rows[3]) >= 50 else set())
    assert set(got) == want
    for i in (50, 51, 52, 53):
        at = len(rows[i]) and next(j for j in range(len(rows[i])) if rows[i][j : j + 60] == passage)
        a, b = map(int, got[i].spans.split(":"))
        assert abs(a - at) <= 3 and abs(b - at - 60) <= 3 and got[i].class_id == 50
    assert got[60].class_id == got[61].class_id == 60 and got[61].n_repeated >= 110
    assert got[81].spans == "0:77" and got[None].class_id == 80
    assert S.repeated(d.where("false")).count() == 0


def test_full_bitmaps_change_nothing(spark):
    rng = np.random.default_rng(5)
    p = say(rng, 70)
    rows = [say(rng, 40) + p + say(rng, 40) for _ in range(6)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    wanted = spark.createDataFrame([(S.text_key([w.encode() for w in rows[0]]), t) for t in (0, 2)], "key long, tile int")
    tiles = [sorted((r.key, r.tile, bytes(r.words)) for r in S.tiles(d, wanted, most).collect()) for most in (6, 24)]
    assert tiles[0] == tiles[1] and len(tiles[0]) == 2


def spots_of(rows):
    """Places of all seeds of texts, in order; the key of a text is its number."""
    t = S.Texts([" ".join(r).encode() for r in rows])
    h, text, at = t.seeds()
    e, b, f = t.contexts(text, at)
    x = {"seed": h.view(np.int64), "exact": e.view(np.int64), "before": b, "behind": f, "key": text.astype(np.int64), "at": (at - t.first[text]).astype(np.int32)}
    order = np.lexsort([x[c] for c in S.ORDER[::-1]])
    return {c: v[order] for c, v in x.items()}


def test_few_places_all_meet_and_many_form_lines():
    rng = np.random.default_rng(12)
    p, q = say(rng, 60, 10**6), say(rng, 90, 10**6)
    rows = [say(rng, 30, 10**6) + x + say(rng, 30, 10**6) for x in [p] * 5 + [q] * 80]
    m = S.meet(spots_of(rows))
    met = {(a, b) for a, b in zip(m["key"].tolist(), m["other"].tolist(), strict=True)}
    assert {(a, b) for a in range(5) for b in range(a)} <= met and (m["key"] > m["other"]).all()
    assert len(m["key"]) < 12 * len(spots_of(rows)["seed"])  # linear, not 80 * 79 / 2 for each seed
    near = {n: {n} for n in range(5, 85)}
    for a, b in met:
        if a >= 5 and near[a] is not near[b]:
            near[a] |= near[b]
            for n in near[a]:
                near[n] = near[a]
    assert len(near[5]) == 80


def test_hot_seeds_give_the_same_classes(spark, monkeypatch):
    """Seeds dealt over many tasks, with lines that go on from one to the next."""
    rng = np.random.default_rng(13)
    p = say(rng, 60, 10**6)
    rows = [say(rng, 20, 10**6) + p + say(rng, 20, 10**6) for _ in range(120)] + [say(rng, 100, 10**6) for _ in range(10)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    shared = S.seed_counts(d)
    held = S.places(d, shared)
    for parts in (1, 10**6):
        pairs = {(r.key, r.other) for r in S.matches(held, shared, parts).where("w = 9").select("key", "other").distinct().collect()}
        keys = sorted({k for x in pairs for k in x})
        from tests_llm_helpers import brute_components

        assert len(keys) == 120 and set(brute_components(keys, pairs).values()) == {keys[0]}


def test_repeated_equals_brute_force(spark):
    """Over all pairs: a text is found exactly if another holds a window of LEAST of its words."""
    rng = np.random.default_rng(14)
    stock = [say(rng, n, 10**6) for n in (50, 51, 53, 55, 60, 80, 49, 40)]
    rows = []
    for _ in range(140):
        row = say(rng, int(rng.integers(5, 60)), 10**6)
        for i in rng.choice(len(stock), int(rng.integers(0, 3)), replace=False):
            row += stock[i] + say(rng, int(rng.integers(45, 70)), 10**6)
        rows.append(row)
    held: dict[tuple, set] = {}
    for i, r in enumerate(rows):
        for a in range(len(r) - S.LEAST + 1):
            held.setdefault(tuple(r[a : a + S.LEAST]), set()).add(i)
    want = {i for x in held.values() if len(x) > 1 for i in x}
    got = found_in(spark, rows)
    from tests_llm_helpers import brute_components

    links = [(a, b) for x in held.values() for a in x for b in x if a < b]
    assert set(got) == want and {i: r.class_id for i, r in got.items()} == brute_components(sorted(want), links)


def test_a_long_chain_does_not_block_the_matches_behind_it():
    """The best predecessor is the best within the gap, as quadratic chaining has it."""
    far = [(10 * i, 10 * i) for i in range(30)]
    near = [(410 + 10 * i, 410 + 10 * i) for i in range(10)]
    assert S.chain(far + near) == [far, near]
    rng = np.random.default_rng(6)
    for _ in range(60):
        m = sorted({(int(a), int(b)) for a, b in rng.integers(0, 400, (rng.integers(1, 60), 2))} | {(7 * i, 7 * i + 3) for i in range(20)})
        score = []
        for i, (a, b) in enumerate(m):
            within = [score[j] - S.COST * (a + b - sum(m[j])) for j in range(i) if 0 < a - m[j][0] <= S.GAP + S.K and 0 < b - m[j][1] <= S.GAP + S.K]
            score.append(S.K + max([0.0, *within]))
        first = S.chain(m)[0]
        assert abs(S.K + sum(S.K - S.COST * (sum(x) - sum(y)) for y, x in zip(first, first[1:], strict=False)) - max(score)) < 1e-6


def edited(p, every):
    return [f"edit{i}" if i % every == every - 1 else w for i, w in enumerate(p)]


def found_in(spark, rows):
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    return {r.doc_id: r for r in S.repeated(d).collect()}


def test_pieces_do_not_hide_an_edited_passage(spark):
    """Few and many texts hold pieces of a passage that two others share with edits."""
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for pieces in (6, 6, 6, 6, 24, 24, 24):
        p = say(rng, 100, 10**6)
        want |= {len(rows), len(rows) + 1}
        rows += [say(rng, 30, 10**6) + x + say(rng, 30, 10**6) for x in (p, edited(p, 9))]
        for i in range(pieces):
            at = 14 * (i % 6)
            rows.append(say(rng, 40, 10**6) + p[at : at + 30] + say(rng, 40, 10**6))
    got = found_in(spark, rows)
    assert set(got) == want and all(got[i].class_id == got[i + 1].class_id == i for i in want if i + 1 in want)


def test_every_place_of_a_seed_counts(spark):
    rng = np.random.default_rng(8)
    p = say(rng, 64, 10**6)
    # the words of the passage stand in pieces further up; the last text quotes it twice
    early = [w for i in range(0, 64, 8) for w in p[i : i + 8] + say(rng, 12, 10**6)]
    q = say(rng, 70, 10**6)
    rows = [say(rng, 40, 10**6) + p, early + say(rng, 60, 10**6) + edited(p, 10), say(rng, 30, 10**6) + q, say(rng, 30, 10**6) + edited(q, 12) + say(rng, 80, 10**6) + edited(q, 11)]
    got = found_in(spark, rows)
    assert set(got) == {0, 1, 2, 3} and got[3].n_passages == 2
    at = len(early) + 60
    assert any(abs(a - at) <= 12 and b >= at + 50 for a, b in (map(int, x.split(":")) for x in got[1].spans.split(",")))


def test_passages_edited_every_few_words(spark):
    rng = np.random.default_rng(9)
    rows = []
    for every in (6, 7, 8, 10, 12):
        for n in (60, 120):
            for _ in range(4):
                p = say(rng, n, 10**6)
                rows += [say(rng, 80, 10**6) + x + say(rng, 80, 10**6) for x in (p, edited(p, every))]
    got = found_in(spark, rows)
    assert set(got) == set(range(len(rows))) and all(r.class_id == i - i % 2 for i, r in got.items())


def test_recall_by_kind_of_edit(spark):
    """Passages of 60 and 120 words with 5 to 15 % of the words replaced, left out or put in."""
    rng = np.random.default_rng(15)
    rows, cases = [], []
    for n in (60, 120):
        for kind in ("replace", "leave out", "put in"):
            for rate in (0.05, 0.1, 0.15):
                for _ in range(8):
                    p, q, equal = say(rng, n, 10**6), [], []
                    for i, w in enumerate(p):
                        hit = rng.random() < rate
                        if not hit or kind == "put in":
                            equal.append((i, len(q), 1))
                            q.append(w)
                        if hit and kind != "leave out":
                            q += say(rng, 1, 10**6)
                    if S.passages(S.pieces(equal)):  # else it is none by the definition
                        cases.append((kind, len(rows)))
                    rows += [say(rng, 80, 10**6) + x + say(rng, 80, 10**6) for x in (p, q)]
    got = found_in(spark, rows)
    for kind in ("replace", "leave out", "put in"):
        hits = [i in got and i + 1 in got and got[i].class_id == got[i + 1].class_id == i for k, i in cases if k == kind]
        assert len(hits) > 40 and sum(hits) >= 0.9 * len(hits)


def test_a_second_passage_behind_a_gap_and_long_texts(spark):
    rng = np.random.default_rng(16)
    first, second, far = say(rng, 300, 10**6), say(rng, 120, 10**6), say(rng, 70, 10**6)
    cut = [w for i, w in enumerate(second) if i % 12 != 11]
    rows = [first + say(rng, 100, 10**6) + second, first + say(rng, 100, 10**6) + cut, say(rng, 30000, 10**6) + far + say(rng, 2000, 10**6), say(rng, 25, 10**6) + far]
    got = found_in(spark, rows)
    assert set(got) == {0, 1, 2, 3} and got[0].n_passages == got[1].n_passages == 2 and got[0].n_repeated >= 410
    a, b = map(int, got[2].spans.split(":"))
    assert abs(a - 30000) <= 1 and abs(b - 30070) <= 1


def crowded_rows(rng, every, cases=8, fillers=24):
    """Pairs of texts with an edited passage, each of whose equal pieces stands in ``fillers`` other texts as well."""
    rows, want = [], set()
    for _ in range(cases):
        p = say(rng, 60, 10**6)
        q = edited(p, every)
        want |= {len(rows), len(rows) + 1}
        rows += [say(rng, 50, 10**6) + x + say(rng, 50, 10**6) for x in (p, q)]
        for a in range(0, 60, every):
            rows += [say(rng, 50, 10**6) + p[a : a + every - 1] + say(rng, 50, 10**6) for _ in range(fillers)]
    return rows, want


def test_crowded_seeds_hide_no_edited_passage(spark):
    """All equal pieces are crowded, and no piece's other holders share a passage."""
    for every in (6, 8):
        rows, want = crowded_rows(np.random.default_rng(20 + every), every)
        got = found_in(spark, rows)
        assert set(got) == want
        firsts = sorted(want)[::2]
        assert all(got[i].class_id == got[i + 1].class_id == i for i in firsts)


def test_pairs_left_out_hold_no_passage():
    """Of places of a seed, those that can't lie in a passage aren't found by aligning them, alone or along chains."""
    rng = np.random.default_rng(30)
    line = say(rng, 14, 10**6)
    rows = []
    for _ in range(40):
        tail = say(rng, 60, 40)
        rows += [say(rng, 50, 10**6) + line + tail + say(rng, 20, 10**6), say(rng, 3, 10**6) + line + [w for w in tail if rng.random() > 0.1] + say(rng, 60, 10**6)]
        rows.append(say(rng, 60, 40) + line)
    t = S.Texts([" ".join(r).encode() for r in rows])
    h, text, at = t.seeds()
    at = at - t.first[text]
    places = {}
    for s, i, a in zip(h.tolist(), text.tolist(), at.tolist(), strict=True):
        places.setdefault(s, []).append((i, a))
    near = {i: [(a, s) for s, j, a in zip(h.tolist(), text.tolist(), at.tolist(), strict=True) if j == i and len(places[s]) > 1] for i in range(len(rows))}
    flat = [(s, i, a) for s, v in places.items() if len(v) > 1 for i, a in v]
    code = [[x % 254 + 1 for x in (t.words(i) >> np.uint64(20)).tolist()] for i in range(len(rows))]
    words, row, spots = np.zeros((len(flat), 2 * S.REACH), np.uint8), [], []
    for n, (_, i, a) in enumerate(flat):
        left, right = code[i][max(0, a - S.REACH) : a][::-1], code[i][a + S.K : a + S.K + S.REACH]
        words[n, : len(left)], words[n, S.REACH : S.REACH + len(right)] = left, right
        for b, s in near[i]:
            if b != a and abs(b - a) <= S.REACH:
                row.append(n)
                spots.append((b - a, s & 65535))
    held = S.Places(words, np.array(row), np.array(spots, S._NEAR))
    i, j = (np.array(v) for v in zip(*[(x, y) for x in range(len(flat)) for y in range(x + 1, len(flat)) if flat[x][0] == flat[y][0] and flat[x][1] != flat[y][1]], strict=True))
    may = held.may(i, j)
    assert held.maybe(i, j)[may].all()
    match = {}
    for x, y, ok in zip(i.tolist(), j.tolist(), may.tolist(), strict=True):
        every, some = match.setdefault((flat[x][1], flat[y][1]), ([], []))
        every.append((flat[x][2], flat[y][2], S.LIKE))
        if ok:
            some.append(every[-1])
    found = {}
    for pair, sides in match.items():
        a, b = ((0, t.words(k)) for k in pair)
        found[pair] = [any(S.straight_passages(a, b, path) or S.passages(S.pieces((x, y, 1) for x, y in S.align(S.numbered(a), S.numbered(b), path))) for path in S.settle(m)[1]) if m else False for m in sides]
    assert sum(x for x, _ in found.values()) >= 20 and all(x == y for x, y in found.values())
    assert 0 < may.sum() < len(may) / 2


def test_places_of_a_common_line_without_more_in_common_are_left_out():
    """A line of 20 words in 60 texts whose other shared seeds are shared with other texts than these."""
    rng = np.random.default_rng(31)
    n = 60
    words = rng.integers(1, 255, (n, 2 * S.REACH)).astype(np.uint8)
    words[:, S.REACH : S.REACH + 16] = words[0, S.REACH : S.REACH + 16]
    spots = np.array([(e, 1000 * i + e % 500) for i in range(n) for e in range(-87, 87, 6) if e], S._NEAR)
    held = S.Places(words, np.repeat(np.arange(n), len(spots) // n), spots)
    i, j = np.triu_indices(n, 1)
    assert held.may(i, j).sum() < len(i) / 500
    # a stretch of 25 more words behind an edit is found
    words[1, S.REACH + 18 : S.REACH + 46] = words[0, S.REACH + 17 : S.REACH + 45]
    held = S.Places(words, np.repeat(np.arange(n), len(spots) // n), spots)
    assert held.may(np.array([0, 1]), np.array([1, 0])).all() and held.maybe(np.array([0]), np.array([1])).all()


def test_scores_of_alignments_equal_a_quadratic_table():
    rng = np.random.default_rng(32)
    words = rng.integers(1, 6, (12, 2 * S.REACH)).astype(np.uint8)
    words[:, 60:S.REACH] = words[:1, 60:S.REACH]
    words[1::2, S.REACH + 3 :] = words[::2, S.REACH : -3]
    words[4, 50:S.REACH] = words[5, S.REACH + 70 :] = 0
    held = S.Places(words, np.zeros(0, np.int64), np.zeros(0, S._NEAR))
    i, j = (v.ravel() for v in np.meshgrid(np.arange(12), np.arange(12)))
    i, j = i[i != j], j[i != j]
    for side in (0, 1):
        got = held.scores(i, j, side)
        for k, (a, b) in enumerate(zip(words.reshape(12, 2, -1)[i, side].tolist(), words.reshape(12, 2, -1)[j, side].tolist(), strict=True)):
            table, best = {(0, 0): 0}, [0] + [-100] * S.REACH
            for x in range(S.REACH + 1):
                for y in range(max(0, x - S.SHIFT), min(S.REACH, x + S.SHIFT) + 1):
                    if x or y:
                        same = x and y and a[x - 1] == b[y - 1] != 0
                        table[x, y] = max(-100, table.get((x - 1, y - 1), -999) + (1 if same else -2 * S.SKIP), table.get((x - 1, y), -999) - S.SKIP, table.get((x, y - 1), -999) - S.SKIP)
                    best[max(x, y)] = max(best[max(x, y)], table[x, y])
            best[S.REACH] += 2 * S.LEAST - S.K - S.REACH
            assert got[:, k].tolist() == best


def test_shuffles_are_freed_only_within(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
