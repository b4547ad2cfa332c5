import random
import unicodedata

import pytest

from loomline.llm import canonical_text, defects, endings, language, leaks, pair_rules, queries, truncation
from tests.llm.tables import DOCUMENTS, ITEMS, REASONING, WORDS, problem, problems, sentence

FORM = canonical_text.canonical()
MODEL = language.LanguageModel.of({})


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("ｆｕｌｌ １２", "full 12", True), ("café", "café", True), ("a​b­", "ab", True), ("x y z", "x y z", True), ("a‑b", "a-b", True),
        ("ﬁne ﬂow oﬀer", "fine flow offer", True), ("ѕсоре", "scope", True), ("Τορ", "Top", False), ("Τοр", "Top", True), ("x²", "x2", False), ("Paris", "paris", False),
        ("resume", "résumé", False), ("a.b", "a,b", False), ("мир", "mir", False), ("ё", "ё", True), ("a\r\nb", "a\nb", True), ("e​́", "é", True), ("й", "и", False), ("a  b", "a b", False),
    ],
)
def test_canonical_form(a, b, same):
    assert (FORM(a) == FORM(b)) is same


def test_segments_equal_whole_text_normalisation():
    """Splicing canonical segments gives what normalising the whole text gives."""
    rng = random.Random(7)
    alphabet = "abcE é́̈ｆ１​ ‑ﬁѕ²жёͅ가각"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 24)))
        assert FORM(text) == canonical_text.canonical_segment(text), ascii(text)
        assert FORM(FORM(text)) == FORM(text)
        assert unicodedata.is_normalized("NFC", FORM(text))


def test_all_code_points_have_one_form_composed_or_not():
    """Every composite equals its decomposition, also those whose second character has combining class 0."""
    for p in range(0x110000):
        c = chr(p)
        if 0xD800 <= p < 0xE000 or unicodedata.category(c) == "Cn":
            continue
        form = FORM(c)
        for other in (unicodedata.normalize("NFD", c), unicodedata.normalize("NFC", c)):
            assert FORM(other) == form and FORM("x" + other + "y") == canonical_text.canonical_segment("x" + c + "y"), hex(p)


def test_shapes_are_a_parameter(tmp_path):
    path = tmp_path / "shapes.txt"
    path.write_text("# source ; target ; type\n03B1 ;\t0061 ;\tMA\t# alpha\n0030 ; 004F ; MA\n0391 ; 0041 ; MA\n0021 ; 01C3 ; MA\n\n", encoding="utf-8")
    own = canonical_text.canonical(str(path))
    assert own("αΑ") == "aA" and own("0") == "0" and own("с") == "с" and FORM("α") == "α" and FORM("օνӀ") == "ovI"


def document(i, text, source="forum"):
    return (i, text, "en", source, "f", "r", 1, 1, "c")


def test_look_alike_pairs(spark):
    long = "word " * 200_000
    rows = [
        document(1, "scope one"), document(2, "ѕcope one"), document(3, "scope one"), document(4, "Scope one"), document(5, None), document(None, "ѕcope one"), document(6, ""), document(7, "​"),
        document(8, long), document(9, long + "​"), *[document(100 + k, "copy") for k in range(50)],
    ]
    found = sorted(tuple(r) for r in canonical_text.look_alike_pairs(spark.createDataFrame(rows, DOCUMENTS)).collect())
    assert found == [(1, 2), (2, 3), (6, 7), (8, 9)]
    assert canonical_text.look_alike_pairs(spark.createDataFrame([], DOCUMENTS)).count() == 0
    classes = {r.doc_id: tuple(r)[1:] for r in canonical_text.look_alike_classes(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert classes == {1: (1, 2, 1), 2: (1, 2, 2), 3: (1, 2, 1), 6: (6, 2, 1), 7: (6, 2, 1), 8: (8, 2, 1), 9: (8, 2, 1)}
    forms = {r.doc_id: r for r in canonical_text.canonical_documents(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert forms[2].canonical == "scope one" and forms[2].segments == 1 and forms[1].segments == 0 and forms[5].canonical is None


def test_look_alike_pairs_of_a_hot_class(spark, monkeypatch):
    """A third of all rows share one form: all pairs of different strings come out, through blocks."""
    from loomline.llm import blocks

    rng = random.Random(4)
    strings = ["scope" + "\u200b" * k for k in range(5)]
    rows = [document(k, rng.choice(strings) if k % 3 == 0 else f"own {k}") for k in range(360)]
    monkeypatch.setattr(blocks.meet, "__defaults__", (16,))
    found = {tuple(r) for r in canonical_text.look_alike_pairs(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    alike = [r for r in rows if r[1].startswith("scope")]
    assert found == {(a[0], b[0]) for i, a in enumerate(alike) for b in alike[i + 1 :] if a[1] != b[1]}


@pytest.mark.parametrize(
    "text, kind",
    [
        (None, "nothing"), ("", "nothing"), ("﻿", "nothing"), ("N/A", "nothing"), ("<think>\n</think>", "nothing"), ("```\n\n```", "nothing"), ("...", "nothing"), ("<think>\nWe start by", "think"),
        ("So.\n```python\nfor x in", "code"), ("We sort the wel", "bare"), ("It is so. We sort the wel", "open"), ("Steps\n- one\n- two", "item"), ("Done.\nIt is 3.", "dot"), ("We sort the wells and…", "omitted"), ("We sort the [...]", "omitted"), ("We sort the wells.", "stop"), ("Fine.\n\nAnswer: 42", "number"),
        ("Fine.\n\nTime O(n), memory O(1)", "result"), ("Fine.\n\nComplexity: O(n log k)", "result"), ("Fine.\n\nComplexity: O(n lo", "open"), ("Код готов.\n\nОтвет: 7", "number"), ("a.\n```py\nx\n```", "block"),
        ("1. One is done.\n2.", "marker"), ("<think>\nSorry.\n</think>", "tags"), ("<think>\nSo the\n</think>", "bare"), ("«Fini.»", "stop"),
    ],
)
def test_endings(text, kind):
    assert endings.ending(text) == kind


def answer(i, text, source="s", source_id="train:1"):
    return (i, None, source, source_id, text, "p", True, 0.5, "t")


def test_truncation(spark):
    rng = random.Random(3)
    rows = [answer(k, sentence(rng, rng.randrange(20, 200)) + ".", "free") for k in range(200)]
    cut = []
    for k in range(200, 300):
        text = sentence(rng, rng.randrange(40, 300)) + "."
        rows.append(answer(k, text[:700], "limited"))
        if len(text) > 700:
            cut.append(k)
    rows += [answer(301, None), answer(302, ""), answer(303, "N/A", None), answer(304, "unfinished sent", None), answer(305, "word " * 300_000), answer(None, "no id here"), answer(306, "unfinished sent", None)]
    df = spark.createDataFrame(rows, REASONING)
    found = {r.reasoning_id for r in truncation.truncated(df).collect()}
    assert found - {304, 305, 306} == set(cut) and {304, 305, 306} <= found
    ends = truncation.text_endings(df)
    limits = {(r.source, r.unit): r for r in truncation.source_limits(ends).collect()}
    assert limits["limited", "chars"].high == 700 and limits["limited", "chars"].posterior > 0.9 and ("free", "chars") not in limits
    report = {r.source: r for r in truncation.truncation_report(df).collect()}
    assert report["limited"].truncated == len(cut) and report["limited"].at_limit == len(cut) and report["free"].truncated == 0
    assert truncation.truncated(spark.createDataFrame([], REASONING)).count() == 0


def numbered(rng, n, digits):
    return sentence(rng, n) + ".\n\nAnswer: " + str(rng.randrange(10 ** (digits - 1), 10**digits))


def test_the_fit_decides_ambiguous_endings(spark):
    """A result that ends in a digit, or a stop after a digit, is cut at a limit and finished elsewhere; without limits all would be finished."""
    rng = random.Random(5)
    rows = [answer(k, numbered(rng, rng.randrange(20, 120), 4) if k % 2 else sentence(rng, rng.randrange(20, 120)) + " by 3.", "free") for k in range(400)]
    rows += [answer(1000 + k, sentence(rng, rng.randrange(20, 60)) + ".", "limited") for k in range(300)]
    cut = set()
    for k in range(2000, 2120):
        head = sentence(rng, 160)
        if k % 3 == 0:
            text = head[: 585 - rng.randrange(3)].rstrip() + ".\n\nAnswer: " + str(rng.randrange(10**40, 10**41))
        elif k % 3 == 1:
            text = head[:588].rstrip() + " by 3."
            text = text.rjust(600, "x") + "14159"
        else:
            text = sentence(rng, 20) + ". " + sentence(rng, 300)
        rows.append(answer(k, text[:600], "limited"))
        cut.add(k)
    df = spark.createDataFrame(rows, REASONING)
    ends = truncation.text_endings(df)
    kinds = {r.reasoning_id: r.kind for r in ends.collect()}
    ambiguous = {k for k in cut if kinds[k] in ("number", "dot")}
    assert len(ambiguous) > 60
    limits = truncation.source_limits(ends)

    def found(limits):
        return {r.reasoning_id for r in truncation.cut_scores(ends, limits).where("score > 0").collect()}

    assert found(limits) == cut == {r.reasoning_id for r in truncation.truncated(df).collect()}
    assert found(limits.where("false")) == cut - ambiguous


def test_neighbours_decide_what_the_ending_leaves_open(spark, monkeypatch):
    """A response whose last number goes on in a longer version of it is cut; without the sorted neighbours it would pass."""
    rng = random.Random(15)
    prompt = sentence(rng, 40)
    texts = [numbered(rng, 30, 6) for _ in range(120)]
    rows = [answer(k, t) for k, t in enumerate(texts)] + [answer(500 + k, texts[k][:-3]) for k in range(0, 40, 4)]
    rows += [answer(700, sentence(rng, 20) + "."), answer(701, rows[-1][4].split("\n")[0])]  # a whole sentence stays finished, though it is a prefix
    p, df = problems(spark, [problem(1, "s:train:1", "train:1", prompt)]), spark.createDataFrame(rows, REASONING)

    def cut():
        return {r.reasoning_id for r in defects.defects(p, df).where("defect = 'truncated'").collect()}

    assert cut() == {500 + k for k in range(0, 40, 4)}
    shortened = defects.shortened
    monkeypatch.setattr(defects, "shortened", lambda reasoning: shortened(reasoning).where("false"))
    assert cut() == set()


def test_censored_fit_recovers_the_law():
    import numpy as np

    x = np.random.default_rng(2).lognormal(6.0, 0.4, 20_000)
    seen = x[x <= 600].astype(int)
    length, count = np.unique(seen, return_counts=True)
    mu, sigma = truncation.censored_lognormal(length, count, 600, float((x > 600).sum()))
    assert abs(mu - 6.0) < 0.02 and abs(sigma - 0.4) < 0.02


@pytest.mark.parametrize(
    "text, told",
    [
        ("The weights of the wells are sorted and each of them is used once.", "en"), ("Die Gewichte der Brunnen sind sortiert und jede davon wird nur einmal benutzt.", "de"),
        ("Les poids des puits sont triés et chacun est utilisé une fois.", "fr"), ("Los pesos de las torres se ordenan y cada una se usa una vez.", "es"), ("Сначала отсортируем веса и пройдём слева направо.", "ru"),
        ("«Les poids des puits sont triés et chacun est utilisé.» Then the rest of the work is done in order by the stack.", "en"), ("x = 1", None), (None, None),
        ("まず重みを並べ替えて、左から右へ調べます。", "hiragana"), ("先对权重排序，然后从左到右扫描一遍。", "han"),
    ],
)
def test_language(text, told):
    assert MODEL.language(text) == told


@pytest.mark.parametrize(
    "text, refusal",
    [
        ("I'm sorry, but I can't help with solving this.", True), ("Leider darf ich zu dieser Frage keine Lösung angeben.", True), ("Je suis désolé, mais je ne peux pas aider.", True), ("Lo siento, pero no puedo ayudar.", True),
        ("К сожалению, дать решение этого вопроса мне нельзя.", True), ("I cannot sort the nets here because the order matters, so I index them instead. Then we sum. The rest is easy. It works. Done.", False),
        ("Unfortunately the first idea fails.\n```python\nprint(1)\n```", False), ("We sort the wells.", False),
        ("That request falls outside my remit, so there will be no code from me.", True), ("Ich helfe dabei nicht.", True), ("Mi dispiace, non posso aiutarti con questo compito.", True), ("抱歉，我无法提供解答。", True),
        ("Unfortunately the greedy approach fails. Use DP instead.", False), ("I never sort twice. The answer is the sum.", False), ("We do not need the code of the heap here. We count the wells and add the weights. Then we stop. The total is printed.", False),
    ],
)
def test_refusal(text, refusal):
    assert pair_rules.is_refusal(text) is refusal


def test_defects(spark):
    prompt = "Every morning the courier walks past many hedges and remembers only those that are tall. Print the number of them and the sum of their weights."
    good = "We sort the hedges by their weight and then walk over all of them once. The sum of the tall ones is the answer."
    german = "Wir sortieren die Hecken nach ihrem Gewicht und gehen dann einmal über alle. Die Summe der hohen ist die Antwort und nicht mehr."
    rows = [
        answer(1, good), answer(2, None), answer(3, "```\n```"), answer(4, good[:60]), answer(5, "I'm sorry, but I can't help with this."), answer(6, "Question:\n" + prompt.upper()), answer(7, german),
        answer(8, good, "other", "train:1"), answer(9, None, None, "train:1"), answer(10, good[:60], "s", None), answer(11, good), answer(12, "word " * 100_000 + "end.", "s", "train:2"), answer(13, good, "s", "train:2"),
    ]
    p = problems(spark, [problem(1, "s:train:1", "train:1", prompt), problem(2, "s:train:1", "train:1", prompt), problem(3, "s:train:2", "train:2", None), problem(4, "s:x", None, prompt)])
    df = spark.createDataFrame(rows, REASONING)
    found = sorted(tuple(r) for r in defects.defects(p, df).collect())
    assert found == [(2, "empty"), (3, "empty"), (4, "truncated"), (5, "refusal"), (6, "copy"), (7, "language")]
    empty = spark.createDataFrame([], REASONING)
    assert defects.defects(p, empty).count() == 0 and defects.defects(problems(spark, []), df).count() == 0


def test_shortened_finds_proper_prefixes_across_partitions(spark):
    rng = random.Random(6)
    texts = [sentence(rng, rng.randrange(3, 30)) for _ in range(400)]
    texts += [t[: rng.randrange(1, len(t))] for t in texts[:150]]
    texts += texts[:20] + [None, ""]
    df = spark.createDataFrame([answer(k, t) for k, t in enumerate(texts)], REASONING)
    kept = sorted({t for t in texts if t})
    want = {a for a, b in zip(kept, kept[1:]) if b.startswith(a)}
    import xxhash

    for spread in (df, df.repartition(9)):
        found = {bytes(r.digest): r.inside for r in defects.shortened(spread).collect()}
        assert set(found) == {xxhash.xxh3_128_digest(t.encode()) for t in want}
    longer = {a: b for a, b in zip(kept, kept[1:]) if b.startswith(a)}
    assert found == {xxhash.xxh3_128_digest(a.encode()): a[-1].isalnum() and b[len(a)].isalnum() for a, b in longer.items()}


def item(i, text):
    return (i, "h:1", text, 5)


def brute_leaks(docs, items, n=12):
    def grams(text):
        w = leaks.reader_words(text)
        return set(zip(*(w[k:] for k in range(n))))

    known = [(i, grams(t)) for i, _, t, _ in items if i is not None]
    return {(d[0], i) for d in docs if d[0] is not None for i, g in known if g & grams(d[1])}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [item(k, sentence(rng, 60)) for k in range(12)] + [item(50, "too short"), item(51, None), item(None, sentence(rng, 40)), item(52, "")]
    docs = [document(k, sentence(rng, rng.randrange(5, 200))) for k in range(120)]
    for k in range(60):
        words = items[k % 12][2].split()
        n = rng.randrange(9, 16)
        at = rng.randrange(0, len(words) - n)
        part = "\n# ".join(w.upper() if rng.random() < 0.3 else w.replace("o", "о") for w in words[at : at + n])
        docs.append(document(1000 + k, f"{sentence(rng, rng.randrange(0, 40))} “{part}”, {sentence(rng, rng.randrange(0, 40))}"))
    docs += [document(2000, docs[-1][1]), document(2001, None), document(2002, ""), document(None, items[0][2]), document(2003, "word " * 50_000 + items[3][2])]
    df, it = spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(items, ITEMS)
    found = [tuple(r) for r in leaks.leaked(df, it).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_leaks(docs, items)
    assert leaks.leaked(spark.createDataFrame([], DOCUMENTS), it).count() == 0
    assert leaks.leaked(df, spark.createDataFrame([], ITEMS)).count() == 0


def test_leaks_recall_on_a_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, None, r.text, None) for r in spark.read.parquet(f"{small}/eval_items.parquet").collect()]
    want = brute_leaks(docs, items)
    found = {tuple(r) for r in queries.p7_found(spark, small).collect()}
    assert found == want


def test_word_hashes_equal_words_of_the_whole_text():
    rng = random.Random(12)
    alphabet = "ab éе́ｆ​\u00a0\u2009‑ﬁ²\n\t.,'\x1c1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(2000)] + [None, ""]
    words, counts = leaks.word_hashes(texts)
    want = [[leaks.HASHES[w] for w in leaks.reader_words(t)] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and words.tolist() == [h for w in want for h in w]


def test_window_index_finds_equal_windows_always_and_alike_ones_mostly():
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24))
    windows = (centres[rng.integers(0, 40, 3000)] + 0.5 * rng.standard_normal((3000, 24))).astype(np.float32)
    windows /= np.linalg.norm(windows, axis=1, keepdims=True)
    of = rng.integers(0, 60, 3000)
    index = leaks.WindowIndex(windows, of)
    noise = rng.standard_normal((500, 24)).astype(np.float32)
    passages = np.concatenate((windows[:800] + np.float32(1e-7), noise / np.linalg.norm(noise, axis=1, keepdims=True)))
    found = set(zip(*(x.tolist() for x in index.search(passages, leaks.SAME, 1))))
    assert {(k, int(of[k])) for k in range(800)} <= found
    assert found <= {(int(i), int(of[j])) for i, j in zip(*np.nonzero(passages @ windows.T >= leaks.SAME - 1e-6))}
    near = windows[:800] + 0.1 * rng.standard_normal((800, 24)).astype(np.float32)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    want = {(int(i), int(of[j])) for i, j in zip(*np.nonzero(near @ windows.T >= leaks.ALIKE))}
    found = set(zip(*(x.tolist() for x in index.search(near, leaks.ALIKE, leaks.PROBES))))
    assert found <= want and len(found) >= 0.9 * len(want)
    empty = leaks.WindowIndex(windows[:0], of[:0])
    assert len(empty.search(passages, leaks.SAME, 1)[0]) == 0 and len(index.search(passages[:0], leaks.SAME, 1)[0]) == 0


def test_items_are_taken_in_blocks(spark, monkeypatch):
    """More item text than one block holds: several blocks, the same leaks."""
    rng = random.Random(19)
    items = [item(k, sentence(rng, 40)) for k in range(30)]
    docs = [document(k, sentence(rng, 30) + " " + " ".join(items[k % 30][2].split()[5:19])) for k in range(60)]
    monkeypatch.setattr(leaks, "MOST_ITEM_CHARS", 2000)
    df, it = spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(items + items[:3], ITEMS)
    assert len(leaks.item_blocks(it)) > 2
    assert {tuple(r) for r in leaks.leaked(df, it).collect()} == brute_leaks(docs, items)


def test_paraphrases(spark):
    rng = random.Random(1)
    words = sentence(rng, 50).split()
    told = " ".join(w for k, w in enumerate(words) if k % 9)
    df = spark.createDataFrame([document(1, told), document(2, sentence(rng, 50)), document(3, " ".join(words))], DOCUMENTS)
    found = leaks.paraphrases(df, spark.createDataFrame([item(7, " ".join(words))], ITEMS)).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 7)] and found[0].subsequence > 0.8


def test_paraphrases_recall(spark):
    """Planted paraphrases (every sixth to ninth word replaced, two clauses swapped) against brute force by the same measures."""
    rng = random.Random(23)
    items = [item(k, " ".join(sentence(rng, 11) + f" {rng.randrange(1000)}." for _ in range(5))) for k in range(25)]
    docs = [document(k, sentence(rng, rng.randrange(20, 150))) for k in range(150)]
    for k in range(100):
        words, gap = items[k % 25][2].split(), rng.randrange(6, 10)
        told = [w if j % gap or w[-1] == "." else rng.choice(WORDS) for j, w in enumerate(words)]
        docs.append(document(1000 + k, f"{sentence(rng, rng.randrange(0, 60))} {' '.join(told[24:36] + told[:24] + told[36:])} {sentence(rng, rng.randrange(0, 60))}"))
    want = set()
    for d in docs:
        own = leaks.reader_words(d[1])
        for i in items:
            asked, named = leaks.reader_words(i[2]), leaks.answers_of(i[2])
            held = len(named.intersection(own)) / len(named) if named else 1.0
            if held >= 0.5 and leaks.longest_common_subsequence(asked, own) / len(asked) >= 0.5 and not brute_leaks([d], [i]):
                want.add((d[0], i[0]))
    found = {(r.doc_id, r.item_id) for r in leaks.paraphrases(spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(want) >= 80 and found <= want and len(found) >= 0.9 * len(want)


def test_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = [[rng.choice("abc") for _ in range(rng.randrange(0, 9))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leaks.longest_common_subsequence(a, b) == table[-1][-1]
