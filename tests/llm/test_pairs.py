import random

import numpy as np
import pytest

from loomline.llm import cross_split, hashing, near_duplicates, queries, records
from tests.llm.tables import brute_pairs, edited, problem, problems, sentence


@pytest.fixture(scope="module")
def corpus():
    """Groups of edited and reordered records, exact copies, a hot phrase in all records, and awkward rows."""
    rng = random.Random(5)
    rows, pos = [], 0
    hot = sentence(rng, 12)
    for g in range(30):
        base = hot + " " + sentence(rng, 110)
        for k in range(rng.choice([1, 1, 2, 4])):
            pos += 1
            split = rng.choice(["train", "test", "valid", "other"])
            text = base if k == 0 else edited(rng, base, rng.randrange(1, 9))
            rows.append(problem(pos, f"g{g}:{k}", f"{split}:{pos}", text, None))
    for k in range(12):  # a hot group of exact copies
        pos += 1
        rows.append(problem(pos, f"hot{k}", f"{'train' if k % 2 else 'test'}:{pos}", hot + " " + sentence(random.Random(1), 60), ""))
    rows.append(problem(pos + 1, "hot0", "test:0", hot + " " + sentence(random.Random(1), 60), ""))  # delivered again
    rows += [
        problem(pos + 2, "null", "train:9", None, None), problem(pos + 3, "empty", "test:9", "", ""), problem(pos + 4, None, "test:9", "x y z", "a"), problem(pos + 5, "short", "train:8", "one two", None),
        problem(pos + 6, "short2", "test:8", "one two", None), problem(None, "nopos", "train:7", "alpha beta gamma delta", None), problem(pos + 7, "nopos2", "test:7", "ALPHA, beta gamma\n delta!", None),
        problem(pos + 8, "nosplit", "plain", "alpha beta gamma delta", None), problem(pos + 9, "nullsplit", None, "alpha beta gamma delta", None),
    ]
    long = " ".join(sentence(rng, 1000) for _ in range(60))
    rows += [problem(pos + 10, "long1", "train:6", long, "x"), problem(pos + 11, "long2", "valid:6", long + " tail", "x")]
    return rows


def truth(rows):
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if r[1] is not None and r[1] not in first:
            first[r[1]] = r
    pairs = brute_pairs([(p, r[7], r[8]) for p, r in first.items()])
    side = {p: 1 if (r[3] or "").startswith("train:") else 2 if (r[3] or "").startswith(("test:", "valid:")) else 0 for p, r in first.items()}
    return pairs, {(a, b) for a, b in pairs if side[a] + side[b] == 3 and side[a] and side[b]}


def test_near_duplicates_equal_brute_force(spark, corpus):
    found = [tuple(r) for r in near_duplicates.near_duplicate_pairs(problems(spark, corpus)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == truth(corpus)[0]


def test_cross_split_equal_brute_force(spark, corpus):
    found = [tuple(r) for r in cross_split.cross_split_pairs(problems(spark, corpus)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == truth(corpus)[1]


def test_report_counts_every_problem_once(spark, corpus):
    df = problems(spark, corpus)
    rows = cross_split.cross_split_report(df, cross_split.cross_split_pairs(df)).collect()
    assert sum(r.problems for r in rows) == len({r[1] for r in corpus} - {None})
    assert sum(r.overlapping for r in rows) == len({x for p in truth(corpus)[1] for x in p})


def test_empty_tables(spark):
    empty = problems(spark, [])
    assert near_duplicates.near_duplicate_pairs(empty).count() == 0
    assert cross_split.cross_split_pairs(empty).count() == 0


def test_whole_table_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/problems.parquet").select("pos", "problem_id", "source_id", "prompt", "reference_code").collect()
    like = [(r.pos, r.problem_id, None, r.source_id, None, None, None, r.prompt, r.reference_code) for r in rows]
    pairs, across = truth(like)
    assert {tuple(r) for r in queries.p4_found(spark, small).collect()} == pairs
    assert {tuple(r) for r in queries.p1_found(spark, small).collect()} == across


def test_long_lists_lose_nothing(spark):
    """Lists longer than the bound go through pairs of coordinates and give the pairs that merging would give."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 10**9, size=(6, 12))
    rows = []
    for cluster in range(6):
        for k in range(9):
            keys = base[cluster].copy()
            keys[rng.integers(0, 12, size=rng.integers(0, 7))] = rng.integers(10**9, 2 * 10**9, size=1)
            rows += [(2 * int(x), cluster * 100 + k) for x in keys]
    lists = spark.createDataFrame(rows, "key long, id long")
    by = {}
    for key, i in rows:
        by.setdefault(i, set()).add(key)
    want = {(a, b) for a in by for b in by if a < b and len(by[a] & by[b]) >= 6}
    short = {tuple(r) for r in near_duplicates.candidate_pairs(lists, 6, 256).collect()}
    split = {tuple(r) for r in near_duplicates.candidate_pairs(lists, 6, 3).collect()}
    assert short == want
    assert split >= want


def test_groups_imply_the_pairs_that_signatures_miss(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0), (2, 3, 1.0), (7, 8, 1.0)], "a long, b long, similarity double")
    assert sorted(tuple(r) for r in near_duplicates.group_candidates(pairs).collect()) == [(2, 4), (3, 4)]


def test_weighted_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, size=n, dtype=np.uint64) for n in (300, 100, 100))
    h = np.concatenate([shared, a, shared, b])
    keys = near_duplicates.signatures(h, np.array([400, 400]), np.ones(800, dtype=np.float32), 256)
    assert not (keys & np.uint64(1)).any()
    assert abs((keys[0] == keys[1]).mean() - 0.6) < 0.1


def test_chunks_do_not_depend_on_what_precedes_them():
    rng = random.Random(2)
    text = sentence(rng, 300)
    words, counts = hashing.words_of([text, sentence(rng, 50) + " " + text])
    digest, sizes, at = cross_split.chunks(words, counts)
    assert sizes[at == 0].sum() == 300 and sizes[at == 1].sum() == 350
    assert len(set(digest[at == 0]) - set(digest[at == 1])) <= 2


def test_joined_chunks_cover_all_words_and_stay_in_their_text():
    rng = random.Random(4)
    words, counts = hashing.words_of([sentence(rng, 80), "", sentence(rng, 40)])
    digest, sizes, at = cross_split.chunks(words, counts)
    times = np.array([1000.0 if d % np.uint64(3) else 1.0 for d in digest])
    d2, s2, a2, t2 = cross_split.join_frequent(digest, sizes, at, times, 128.0)
    assert [int(s2[a2 == k].sum()) for k in range(3)] == counts.tolist()
    keep = cross_split.posted(d2, s2, a2, t2, counts, 128.0, 0.1)
    for k in (0, 2):
        assert s2[(a2 == k) & ~keep].sum() <= 0.1 * counts[k]


def test_sketch_never_forgets_and_bitmap_holds_all(spark):
    ids = spark.range(0, 5000, 7)
    packed = hashing.bitmap(ids)
    assert hashing.in_bitmap(np.arange(0, 5000, 7), packed).all()
    assert hashing.in_bitmap(np.arange(1, 5000, 7), packed).mean() < 0.01
    df = problems(spark, [problem(i, f"p{i}", prompt=f"a b c d own{i}") for i in range(40)] + [problem(99, "copy", prompt="a b c d own3")])
    (codes,), members = records.counted_members(records.problem_records(df), [(16, near_duplicates.sequences_of)])
    assert abs(hashing.occurrences(codes).max() - 40) < 8 and members.count() == 41


def test_null_positions_do_not_mix_records(spark):
    """Records without a position, or of files that share positions, are compared by their own texts."""
    rng = random.Random(31)
    base, other = sentence(rng, 60), sentence(rng, 60)
    rows = [problem(None, "a", "train:1", base, None), problem(None, "b", "test:2", edited(rng, base, 2), None), problem(None, "c", "test:3", other, None), problem(7, "d", "train:4", sentence(rng, 60), None)]
    rows += [problem(7, "e", "test:5", sentence(rng, 60), None), problem(7, "f", "train:6", edited(rng, other, 2), None)]
    found = {tuple(r) for r in near_duplicates.near_duplicate_pairs(problems(spark, rows)).collect()}
    assert found == {("a", "b"), ("c", "f")} == {tuple(r) for r in cross_split.cross_split_pairs(problems(spark, rows)).collect()}


def test_classes_and_links(spark, corpus):
    """One row per problem with its class, copies, links and group, against the list of all pairs."""
    pairs, words = truth(corpus)[0], {}
    for r in sorted(corpus, key=lambda r: (r[0] is None, r[0])):
        if r[1] is not None:
            words.setdefault(r[1], tuple(f"{r[7] or ''} {r[8] or ''}".lower().replace(",", " ").replace("!", " ").split()))
    near, group = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    def reach(x, seen):
        for y in near[x] - seen:
            seen.add(y)
            reach(y, seen)
        return seen
    found = {r.problem_id: r for r in near_duplicates.near_duplicate_classes(problems(spark, corpus)).collect()}
    assert set(found) == set(near)
    for p, r in found.items():
        copies = {q for q in near[p] if words[q] == words[p]} | {p}
        assert (r.class_id, r.copies, r.links, r.group_id) == (min(copies), len(copies), len(near[p] - copies), min(reach(p, {p})))


def test_overlap_per_record(spark, corpus):
    across = truth(corpus)[1]
    links = {}
    for a, b in across:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    found = {r.problem_id: r for r in cross_split.cross_split_overlap(problems(spark, corpus)).collect()}
    assert {p: r.links for p, r in found.items()} == links
    assert all(r.similarity >= 0.5 and (r.overlap is None or 0 < r.overlap <= 1) and r.split in ("train", "test", "valid") for r in found.values())
    assert found["hot1"].overlap == 1.0


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 201)]
    rng.shuffle(edges)
    found = {r.id: r.root for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def test_hot_keys_meet_in_cells():
    """A hot key is split into cells; each train record meets each held-out one exactly once."""
    n = 60
    ids, side = np.arange(n, dtype=np.int64), np.where(np.arange(n) % 3 == 0, 1, 2).astype(np.int8)
    keys = np.full(n, 77, dtype=np.uint64)
    cell, row = cross_split.cells(keys, ids, side, np.full(n, 3.5 * cross_split.HOT))
    meets = [(int(ids[row[x]]), int(ids[row[y]])) for x in range(len(row)) for y in range(len(row)) if cell[x] == cell[y] and side[row[x]] == 1 and side[row[y]] == 2]
    assert sorted(meets) == sorted((a, b) for a in range(n) if a % 3 == 0 for b in range(n) if b % 3)
    assert len(set(cell.tolist())) == 16
    assert (cross_split.cells(keys, ids, side, np.full(n, 9.0))[0] == keys).all()


def edited_once(rng, base, edits, tag):
    """base with `edits` words replaced by words that no other record has."""
    words = base.split()
    for k, at in enumerate(rng.sample(range(len(words)), edits)):
        words[at] = f"own{tag}x{k}"
    return " ".join(words)


def big_group(members, edits, copies=0):
    """Variants of a text by a few own words, half of them held out, the text itself with copies, and other records."""
    rng = random.Random(members + edits)
    base = sentence(rng, 120)
    texts = [edited_once(rng, base, edits, k) for k in range(members)] + [base] * copies + [sentence(rng, 120) for _ in range(50)]
    return [problem(k, f"m{k}", f"{'train' if k % 2 else 'test'}:{k}", text, None) for k, text in enumerate(texts)]


def group_truth(rows):
    """truth(rows) by a matrix product of the sets of sequences."""
    sets = [set(zip(w, w[1:], w[2:])) for w in (r[7].split() for r in rows)]
    column = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(rows), len(column)), dtype=np.float32)
    for i, s in enumerate(sets):
        has[i, [column[g] for g in s]] = 1
    both, n = has @ has.T, has.sum(axis=1)
    x, y = np.nonzero(np.triu(both / (n[:, None] + n - both) >= 0.5, 1))
    pairs = {tuple(sorted((rows[a][1], rows[b][1]))) for a, b in zip(x, y)}
    return pairs, {(a, b) for a, b in pairs if (int(a[1:]) + int(b[1:])) % 2}


BIG = [(100, 3, 0), (300, 8, 0), (1000, 3, 0), (5, 3, 1000)]


@pytest.mark.parametrize("members, edits, copies", BIG)
def test_near_duplicates_of_big_groups(spark, members, edits, copies):
    rows = big_group(members, edits, copies)
    found = [tuple(r) for r in near_duplicates.near_duplicate_pairs(problems(spark, rows)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == group_truth(rows)[0]


@pytest.mark.parametrize("members, edits, copies", BIG)
def test_cross_split_pairs_of_big_groups(spark, members, edits, copies):
    rows = big_group(members, edits, copies)
    found = [tuple(r) for r in cross_split.cross_split_pairs(problems(spark, rows)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == group_truth(rows)[1]


def test_repeated_passages_count_once_in_overlaps(spark):
    """Records of 30 words and a line repeated 60 or 100 times, against the same with one word changed."""
    rng, rows, pairs = random.Random(8), [], set()
    for k, (line, times) in enumerate([(10, 60), (20, 100)] * 5):
        text = sentence(rng, 30) + f" {sentence(rng, line)}" * times
        words = text.split()
        words[15] = f"own{k}"
        rows += [problem(2 * k, f"a{k}", "train:1", text, None), problem(2 * k + 1, f"b{k}", "test:1", " ".join(words), None)]
        pairs.add((f"a{k}", f"b{k}"))
    found = records.problem_records(problems(spark, rows))
    codes, _ = records.counted_members(found, [(16, cross_split.chunk_digests), (16, near_duplicates.sequences_of)])
    assert cross_split.overlaps(cross_split.posted_chunks(found, *codes).where("size > 0")).count() == len(pairs)
    assert {tuple(r) for r in cross_split.cross_split_pairs(problems(spark, rows)).collect()} == pairs == truth(rows)[1]
