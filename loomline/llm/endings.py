"""How a text ends, read off its structure and its last line.

Some kinds of ending settle the matter by definition (DECIDED). Cut off are an open thinking section, an open code block, a mark of
omission after an unfinished sentence, a bare list marker, and a last sentence without a stop in a text whose other sentences have one.
Finished are a closed code block, a full stop after a word and a closed result. The others (BELIEF) only speak for one side; how strongly
is estimated in `truncation`.
"""

from __future__ import annotations

import re

# What a whole text may be when it says nothing.
PLACEHOLDERS = {"n/a", "na", "none", "null", "nil", "nan", "-", "--", "—", "...", "…", ".", "?", "tbd", "todo", "[]", "{}", "empty", "undefined"}
#: Characters that show nothing, besides blank space.
HIDDEN = "­͏؜ᅟᅠ᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿\x00-\x08\x0e-\x1f\x7f"
_TAIL = re.compile(f"[\\s{HIDDEN}]+$")
_NOTHING = re.compile(f"[\\s{HIDDEN}]+")
_FENCE = re.compile(r"^[ \t>]*(```+|~~~+)", re.M)
_TAGS = re.compile(r"</?think>", re.I)
_OMITTED = re.compile(r"\s*(?:\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)|\.{2,}|…)$")
_CLOSERS = "\"'”’»«“)]}*_`>"
_STOPS = ".!?。！？։؟…"
#: A label, a colon and a value that is whole: a number, a word in capitals, or closed brackets.
_RESULT = re.compile(r"[^\W\d_][\w ()/-]{0,30}?\s?[:：=]\s?(?:[-−+]?\d[\d.,]*%?|[A-Z]{2,}|[^:]*[)\]}])$")
_COST = re.compile(r"[^\W\d_][^.:\n]{0,30}\b[OΘΩ]\([^()]*(?:\([^()]*\)[^()]*)*\)(?:[ ,;]+[^.:\n]{0,30}\b[OΘΩ]\([^()]*(?:\([^()]*\)[^()]*)*\))*$")
_SHORT = re.compile(r"(?:\d|(?<![^\W\d_])[^\W\d_]{1,2})\.$")
_SENTENCE_END = re.compile(f"[{re.escape(_STOPS)}][{re.escape(_CLOSERS)}]*\\s")
_NUMBERED = re.compile(r"(?:^|\n)[ \t]*(?:\d{1,3}[.)]|[-*•])$")
_ITEM = re.compile(r"[ \t]*(?:\d{1,3}[.)]|[-*•])[ \t]+\S")

#: Kinds that settle whether a text is cut off.
DECIDED = {"think": True, "code": True, "omitted": True, "marker": True, "open": True, "block": False, "stop": False, "result": False, "tags": False}
#: What is believed of the other kinds before any text is seen: their shares among cut texts and among finished ones.
#: bare: a text without any stop; item: an item of a list whose items have no stop; number: a result that ends in a digit; dot: a full stop
#: after a digit or a short word, which may be a decimal point or an abbreviation.
BELIEF = {"bare": (0.70, 0.0002), "item": (0.20, 0.0002), "number": (0.008, 0.15), "dot": (0.008, 0.10)}


def says_nothing(text: str | None) -> bool:
    """Null, blank, invisible, a bare placeholder, or only empty blocks."""
    if text is None:
        return True
    inner = _TAGS.sub(" ", text)
    if "```" in inner or "~~~" in inner:
        inner = re.sub(r"(?m)^[ \t>]*(?:```+|~~~+)[ \t]*[\w+#.-]*[ \t]*$", " ", inner)
    inner = _NOTHING.sub(" ", inner).strip()
    return not inner or inner.casefold() in PLACEHOLDERS


def ending(text: str | None) -> str:
    """The kind of ending of a text: 'nothing', or one of DECIDED and BELIEF."""
    if says_nothing(text):
        return "nothing"
    body = _TAIL.sub("", text)
    lower = body.lower()
    if lower.rfind("<think>") > lower.rfind("</think>"):
        return "think"
    if len(_FENCE.findall(body)) % 2:
        return "code"
    cut = _OMITTED.search(body)
    if cut:
        rest = _TAIL.sub("", body[: cut.start()])
        return "omitted" if rest and rest.rstrip(_CLOSERS)[-1:] not in _STOPS or not rest else "stop"
    if lower.endswith("</think>"):
        inner = _TAIL.sub("", body[: -len("</think>")])
        body = inner or body
        if not inner.rstrip(_CLOSERS)[-1:] or inner.rstrip(_CLOSERS)[-1] in _STOPS or "<think>" not in lower:
            return "tags"
    last = body.rsplit("\n", 1)[-1].strip()
    if re.match(r"(```+|~~~+)\s*$", last):
        return "block"
    if _NUMBERED.search(body):
        return "marker"
    if _RESULT.match(last) or _COST.match(last):
        return "number" if body[-1].isdigit() else "result"
    bare = body.rstrip(_CLOSERS)
    if bare and bare[-1] in _STOPS:
        return "dot" if bare[-1] == "." and _SHORT.search(bare) else "stop"
    before = body[: -len(last)].rstrip().rstrip(_CLOSERS)[-1:]
    if before and before not in _STOPS and _ITEM.match(last):
        return "item"
    return "open" if _SENTENCE_END.search(body) else "bare"
