"""Small tables with the awkward rows that every operator has to bear."""

import random

PROBLEMS = (
    "pos long, problem_id string, source string, source_id string, difficulty string, topic string, lang string, prompt string, reference_code string, "
    "tests array<struct<test_id:string,input:string,output:string>>, id long, key string, digest string, chunk string, text string, r string"
)
REASONING = "reasoning_id long, problem_id string, source string, source_id string, reasoning string, prompt string, cut boolean, score double, text string"
DOCUMENTS = "doc_id long, text string, lang string, source string, form string, raw string, tokens long, copies long, content string"
ITEMS = "item_id long, problem_id string, text string, doc_id long"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "li", "mu", "te") for b in ("r", "n", "s", "l") for c in ("a", "o", "ix", "um", "e", "yt")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k] = rng.choice(WORDS) + str(rng.randrange(1000))
    return " ".join(words)


def problem(pos, pid, source_id="train:1", prompt="p", code="c", tests=None, source="s", lang="en", topic="dp"):
    return (pos, pid, source, source_id, "easy", topic, lang, prompt, code, tests, 1, "k", "d", "c", "t", "r")


def problems(spark, rows):
    return spark.createDataFrame(rows, PROBLEMS)


def shingles(prompt, code):
    import re

    words = re.findall(r"\w+", f"{prompt or ''} {code or ''}".lower())
    return set(zip(words, words[1:], words[2:]))


def brute_pairs(rows, least=0.5):
    """rows: (problem_id, prompt, code); all pairs by definition."""
    out, sets = set(), [(p, shingles(a, b)) for p, a, b in rows]
    for i, (p, x) in enumerate(sets):
        for q, y in sets[i + 1 :]:
            if x and y and len(x & y) / len(x | y) >= least:
                out.add((min(p, q), max(p, q)))
    return out
