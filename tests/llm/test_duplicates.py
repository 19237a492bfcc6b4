"""Near duplicates of texts, lines, passages and vectors against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from trendspark.llm import line_dedup, passage_dedup, simhash, vector_neardup
from trendspark.llm.components import components


def roots(nodes, links):
    """Smallest member of each component by plain union."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    draw = random.Random(1)
    links = {
        "random": [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(260)],
        "path": [(i * 7 % 101, (i + 1) * 7 % 101) for i in range(100)], "star": [(500, i) for i in range(200)] * 2, "none": [],
    }[kind]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    want = roots({n for link in links for n in link}, links)
    assert got == {n: r for n, r in want.items() if n != r}


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_groups(spark):
    draw = random.Random(2)
    base = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(120)) for _ in range(12)]
    texts = list(base)
    for b in base:
        for _ in range(6):
            words = b.split()
            words[draw.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    texts += [None, "", " \n", "One", "one", "one two", "x y"] + [base[0]] * 5
    ids = [*range(len(texts) - 1), None]
    docs = spark.createDataFrame([(i, t, "f") for i, t in zip(ids, texts)], "doc_id bigint, text string, fingerprint string")
    got = simhash.near_duplicate_groups(docs).collect()
    prints = [plain_simhash(t) for t in texts]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((i is None, i or 0, f"{p:016x}") for i, p in zip(ids, prints))
    n = len(texts)
    links = [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert len(links) > 40
    want = roots(range(n), links)
    assert {r.doc_id: r.component_id for r in got} == {i: want[at] for at, i in enumerate(ids)}
    kept = simhash.one_of_each_group(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values())) and kept[0].fingerprint == "f"
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


def lines(draw, n, words=9):
    return ["".join(" " + draw.choice("klmnop") * draw.randint(1, 5) + str(draw.randint(0, 999)) for _ in range(words))[1:] for _ in range(n)]


def test_repeated_lines_go_and_clean_ones_stay(spark):
    draw = random.Random(4)
    passage, short = lines(draw, 7), lines(draw, 1)
    one, two, three = lines(draw, 12), lines(draw, 9), lines(draw, 5)
    texts = {
        1: one[:6] + passage + one[6:], 2: two[:2] + passage + two[2:], 3: three + short, 4: lines(draw, 4) + short,
        5: one[:6] + passage + one[6:], 6: passage + [" "] + passage, 7: [], 8: lines(draw, 1, 80),
    }
    rows = [(i, "\n".join(t), 0) for i, t in texts.items()] + [(9, None, 0), (2, "\n".join(texts[2]), 0), (10, "\n".join(texts[8]), 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got[1].text == "\n".join(texts[1]) and got[1].n_removed == 0 and got[1].n_lines == 19
    assert got[2].text == "\n".join(two) and got[2].n_removed == 7
    assert got[3].n_removed == got[4].n_removed == 0  # one short line is no run
    assert got[5].text == "" and got[5].n_removed == 19
    assert got[6].n_removed == 14 and got[6].text.strip() == ""
    assert got[7].text == "" and got[9].text is None and got[8].n_removed == 0 and got[10].text == ""
    assert line_dedup.without_repeated_lines(docs).count() == len(rows)
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0


def test_winnowing_keeps_its_guarantee():
    draw = random.Random(6)
    for _ in range(60):
        shared = [line.encode() for line in lines(draw, draw.randint(4, 12), 6) + lines(draw, 5, 6)]
        prints = []
        for _ in range(2):
            text = [x.encode() for x in lines(draw, draw.randint(0, 9), 5)] + shared + [x.encode() for x in lines(draw, draw.randint(0, 9), 7)]
            _, _, h, w = line_dedup.split_lines(b"\n".join(text))
            prints.append({g for g, _ in line_dedup.winnow(h, w)})
        assert prints[0] & prints[1]


def test_a_whole_passage_goes_where_its_fingerprint_stands_first_in_a_part(spark):
    draw = random.Random(41)

    def prints(held):
        _, _, hashes, words = line_dedup.split_lines("\n".join(held).encode())
        return {g for g, _ in line_dedup.winnow(hashes, words)}

    while True:  # until the block is all that the fingerprints of 2 and 3 have in common
        passage = lines(draw, 10, 8)
        one, two, three = lines(draw, 3) + passage[3:7] + lines(draw, 3), *(lines(draw, 2) + passage + lines(draw, 2) for _ in "23")
        common = prints(two) & prints(three)
        if len(common) == 1 and common <= prints(one):
            break
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate((one, two, three), 1)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 10 and got[3].text == "\n".join(three[:2] + three[-2:])


def test_a_longer_match_of_another_distance_is_not_skipped():
    def match(*at):
        here, there = [1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 0, 3, 4, 5, 6, 7, 8]
        row = {"key": 1, "here": here, "there": there, "words": [9] * 8, "here_from": 0, "there_from": 0, "at": [{"pos": p, "other": q} for p, q in at]}
        (out,) = line_dedup._extend([pa.RecordBatch.from_pylist([row])])
        return [(r["first"], r["last"]) for r in out.to_pylist()]

    assert match((0, 0), (2, 5)) == [(0, 3), (2, 7)] and match((0, 0), (1, 1)) == [(0, 3)]


def plain_chain_score(pos, other):
    """Best chain score by trying all predecessors."""
    order = sorted(zip(pos, other))
    best = []
    for j, (p, q) in enumerate(order):
        reach = [
            best[i] - passage_dedup.GAP_COST * (p - a + q - b) for i, (a, b) in enumerate(order[:j])
            if a < p and b < q
        ]
        best.append(1 + max([0, *reach]))
    return max(best)


def test_chains_score_as_well_as_brute_force():
    draw = random.Random(8)
    for _ in range(50):
        pos, other = [], []
        for _ in range(draw.randint(1, 25)):
            pos.append(draw.randint(0, 60))
            other.append(draw.randint(0, 60))
        links = passage_dedup.chain(np.array(pos), np.array(other))
        assert sorted(int(x) for c in links for x in c) == list(range(len(pos)))
        for c in links:
            assert all(pos[a] < pos[b] and other[a] < other[b] for a, b in zip(c, c[1:]))
        first = links[0]
        cost = passage_dedup.GAP_COST * (pos[first[-1]] - pos[first[0]] + other[first[-1]] - other[first[0]])
        assert len(first) - cost == pytest.approx(plain_chain_score(pos, other))


def limited_chain_scores(pos, other):
    """Best score of a chain that ends at each match, by trying all predecessors within reach."""
    order = sorted(zip(pos, other))
    best = []
    for j, (p, q) in enumerate(order):
        best.append(1 + max([0.0] + [
            best[i] - passage_dedup.GAP_COST * (p - a + q - b) for i, (a, b) in enumerate(order[:j])
            if 0 < p - a <= passage_dedup.MAX_GAP and 0 < q - b <= passage_dedup.MAX_GAP
        ]))
    return best


def test_chains_reach_no_further_than_the_gap_and_look_at_all_within():
    draw = random.Random(18)
    for _ in range(50):
        n = draw.randint(1, 60)
        pos, other = [draw.randint(0, 1500) for _ in range(n)], [draw.randint(0, 1500) for _ in range(n)]
        shift = draw.randint(0, 600)
        pos += range(0, 50, 2)
        other += range(shift, shift + 50, 2)
        links = passage_dedup.chain(np.array(pos), np.array(other))
        assert sorted(int(x) for c in links for x in c) == list(range(len(pos)))
        for c in links:
            assert all(0 < pos[b] - pos[a] <= 256 and 0 < other[b] - other[a] <= 256 for a, b in zip(c, c[1:]))
        first = links[0]
        cost = passage_dedup.GAP_COST * (pos[first[-1]] - pos[first[0]] + other[first[-1]] - other[first[0]])
        assert len(first) - cost == pytest.approx(max(limited_chain_scores(pos, other)))


def test_a_second_passage_of_one_pair_keeps_its_chain():
    # 24 seeds in a row, and 300 words on a second passage with a word put in.
    pos = [*range(0, 120, 5), *range(420, 440, 5), *range(441, 461, 5)]
    other = [*range(0, 120, 5), *range(420, 440, 5), *range(440, 460, 5)]
    links = passage_dedup.chain(np.array(pos), np.array(other))
    assert sorted(map(len, links)) == [8, 24]


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    draw = random.Random(9)

    def words(n):
        return [draw.choice("bcdfg") + draw.choice("aeiou") + str(draw.randint(0, 5000)) for _ in range(n)]

    passage, rows, planted = words(70), [], set()
    for i in range(30):
        text = words(draw.randint(60, 300))
        if i % 3 == 0:
            held = list(passage)
            for _ in range(i // 6):
                held[draw.randrange(70)] = "changed"
            at = draw.randint(0, len(text))
            text[at:at] = held
            planted.add(i)
        rows.append((i, " ".join(text)))
    exact = rows[1][1]
    rows += [(100, exact), (101, exact), (102, None), (103, ""), (104, "a b c"), (105, "a b c"), (106, "same " * 500), (None, words(5)[0])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int")
    got = passage_dedup.shared_passages(docs).collect()
    seen = {r.doc_id for r in got} | {r.other_doc_id for r in got}
    assert planted <= seen and seen <= planted | {1, 100, 101, 104, 105}
    linked = roots(seen, [(r.doc_id, r.other_doc_id) for r in got])
    assert len({linked[i] for i in planted}) == 1
    assert {(r.doc_id, r.other_doc_id) for r in got if r.doc_id in (100, 101, 105)} == {(100, 1), (101, 1), (105, 104)}
    assert all(r.similarity >= 0.8 and (r.end - r.start >= 40 or r.doc_id == 105) for r in got)
    assert passage_dedup.shared_passages(docs.limit(0)).count() == 0


def test_passages_whose_parts_stand_in_earlier_documents(spark):
    draw = random.Random(31)

    def words(n):
        return [f"w{draw.randint(0, 10**9)}" for _ in range(n)]

    passage = words(60)
    texts = {
        "C": words(50) + passage[:35] + words(50), "D": words(50) + passage[25:] + words(50),
        "A": words(50) + passage + words(50), "B": words(50) + passage[:28] + ["changed"] + passage[29:] + words(50),
    }
    texts = {k: " ".join(v) for k, v in texts.items()}
    tried = spark.createDataFrame([(i, k, t) for k, t in texts.items() for i in range(40)], "doc_id bigint, name string, text string")
    keys = {(r.name, r.doc_id): r.key for r in tried.select("name", "doc_id", passage_dedup.row_key().alias("key")).collect()}
    ids = {k: (min if k in "CD" else max)(range(40), key=lambda i: keys[k, i]) for k in texts}
    assert max(keys[k, ids[k]] for k in "CD") < min(keys[k, ids[k]] for k in "AB") and len(set(ids.values())) == 4
    docs = spark.createDataFrame([(ids[k], t) for k, t in texts.items()], "doc_id bigint, text string")
    got = passage_dedup.shared_passages(docs).collect()
    assert [{r.doc_id, r.other_doc_id} for r in got] == [{ids["A"], ids["B"]}]
    assert all((r.start, r.end, r.other_start, r.other_end) == (50, 110, 50, 110) for r in got)


def edited(draw, words, share):
    """The words with a share of them changed, left out or followed by another one."""
    out, at = [], set(draw.sample(range(len(words)), round(len(words) * share)))
    for i, word in enumerate(words):
        kind = draw.choice(["change", "change", "drop", "add"]) if i in at else "keep"
        out += {"keep": [word], "change": [f"x{draw.random()}"], "drop": [], "add": [word, f"y{draw.random()}"]}[kind]
    return out


@pytest.mark.parametrize("share, least", [(0.1, 0.99), (0.15, 0.93), (0.2, 0.8)])
def test_short_passages_with_many_edits(share, least):
    draw, found, n = random.Random(29), 0, 300
    for _ in range(n):
        words = [[f"w{draw.random()}" for _ in range(k)] for k in (50, 60, 60, 60, 60)]
        a, b = words[1] + words[0] + words[2], words[3] + edited(draw, words[0], share) + words[4]
        (h, p, _), (g, q, _) = (passage_dedup.seeds(" ".join(x).encode()) for x in (a, b))
        _, i, j = np.intersect1d(h, g, return_indices=True)
        chains = passage_dedup.chain(p[i], q[j]) if len(i) else []
        got = [x for c in chains for x in passage_dedup.passages(a, b, p[i][c].tolist(), q[j][c].tolist())]
        assert all(x[0] >= 55 and x[1] <= 115 for x in got)
        found += bool(got)
    assert found >= least * n, found


def test_one_seed_is_followed_past_missing_words():
    words = [f"w{i}" for i in range(60)]
    other = words[:20] + words[21:33] + ["new"] + words[33:]
    assert passage_dedup.align(words, other, [25], [24]) == (0, 60, 0, 60, 59 / 60)


def test_a_passage_is_not_lost_to_a_stock_phrase_on_its_chain():
    draw = random.Random(30)
    passage, phrase, *rest = ([f"w{draw.random()}" for _ in range(n)] for n in (50, 12, 90, 90))
    a, b = (passage + between + phrase for between in rest)
    pos = [*range(0, 46, 3), *range(140, 148, 3)]
    assert [x[:4] for x in passage_dedup.passages(a, b, pos, pos)] == [(0, 50, 0, 50)]


def plain_vectors(rows):
    fit = [
        i for i, (_, v, label) in enumerate(rows)
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = []
    for n, i in enumerate(fit):
        for j in fit[:n]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links.append((i, j))
    return links


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(25):
        centre = rng.standard_normal(16)
        for _ in range(8):
            rows.append((len(rows), (centre + 0.09 * rng.standard_normal(16)).astype(np.float32).tolist(), c % 3))
    first = rows[0][1]
    odd = [first, first, [2 * x for x in first], None, [0.0] * 16, [None, *first[1:]], [float("nan"), *first[1:]], [float("inf"), *first[1:]], first[:8], []]
    rows += [(1_000 + i, v, 0) for i, v in enumerate(odd)] + [(2_000, first, None), (2_001, [1e-30 * x for x in first], 0)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id bigint, embedding array<float>, label int, n_links int")
    got = {r.vec_id: r for r in vector_neardup.near_duplicate_vectors(frame).collect()}
    links = plain_vectors(rows)
    want = roots(range(len(rows)), links)
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and 0.95 * 2 * len(links) <= found <= 2 * len(links)
    for i, (vec, _, _) in enumerate(rows):
        assert got[vec].component_id == rows[want[i]][0] and got[vec].kept == (want[i] == i)
    assert vector_neardup.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_recall_of_links(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    got = vector_neardup.near_duplicate_vectors(vectors).collect()
    assert sum(r.n_links for r in got) >= 0.95 * 2 * len(plain_vectors(rows))


def test_all_links_of_a_dense_ball_and_of_pairs_at_the_limit(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(32)
    ball = centre / np.linalg.norm(centre) + 0.0155 * rng.standard_normal((5_000, 32))
    one = rng.standard_normal((2_000, 32))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side = rng.standard_normal((2_000, 32))
    side -= (side * one).sum(axis=1, keepdims=True) * one
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9801, 0.985, (2_000, 1))
    x = np.concatenate([ball, one, cosine * one + np.sqrt(1 - cosine**2) * side])
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_neardup.near_duplicate_vectors(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit[:5_000] @ unit[:5_000].T >= 0.98).sum(axis=1) - 1
    assert want.mean() > 2_000 and (want < 4_999).any()
    assert [got[i].n_links for i in range(5_000)] == want.tolist()
    linked = sum(got[5_000 + i].component_id == got[7_000 + i].component_id for i in range(2_000))
    assert linked >= 0.99 * 2_000


def test_slices_and_passes():
    rng = np.random.default_rng(4)
    i, j = rng.integers(0, 400, 150), rng.integers(0, 400, 150)
    want = roots(range(400), [(a, b) for a, b in zip(i.tolist(), j.tolist()) if a != b])
    assert vector_neardup._roots(400, i, j).tolist() == [want[n] for n in range(400)]
    assert vector_neardup.passes_for(1_000, 256) == vector_neardup.PASSES < vector_neardup.passes_for(10**9, 256) < 40


def test_extended_runs_against_every_match_on_its_own():
    draw = random.Random(9)
    for _ in range(400):
        here, there = ([draw.randint(0, draw.choice([0, 1, 3])) for _ in range(draw.randint(1, 60))] for _ in range(2))
        if draw.random() < 0.3:
            there = here
        words = [draw.randint(1, 9) for _ in here]
        places = [(i, j) for i, h in enumerate(here) for j, t in enumerate(there) if h == t and (there is not here or j < i)]
        at = draw.sample(places, min(len(places), draw.randint(0, 40)))
        want = set()
        for i, j in at:
            first, last, k = i, i, j
            while first and k and here[first - 1] == there[k - 1]:
                first, k = first - 1, k - 1
            while last + 1 < len(here) and j + last + 1 - i < len(there) and here[last + 1] == there[j + last + 1 - i]:
                last += 1
            if sum(words[first:last + 1]) >= line_dedup.GRAM_WORDS:
                want |= set(range(first, last + 1))
        found = line_dedup.extend(np.array(here), np.array(there), np.concatenate(([0], np.cumsum(words))), at)
        assert {n for a, b in found for n in range(a, b + 1)} == want
        assert sorted(found) == found and all(a[1] < b[0] for a, b in zip(found, found[1:]))


def test_a_text_of_many_equal_lines(spark):
    n = 300_000
    log = "the same five words here\n" * n
    docs = spark.createDataFrame([(1, log), (2, "a line of its own"), (3, log[:25 * 40])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got[1].n_lines == n and got[1].n_removed == n - 1
    assert got[2].n_removed == 0 and got[3].n_removed == 40
