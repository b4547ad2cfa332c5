"""Rules that look at one prompt and one response: copy, refusal and language."""

from __future__ import annotations

import re

from .hashing import WORD
from .language import LanguageModel

# Words of declining, per language, in four roles. `refuse` declines by itself. A sentence also declines if it holds a
# negation and an offer (what a response would give) together with the speaker, regret or courtesy.
ROLES = {
    "refuse": [
        r"(?:must|have to|need to|will|would|going to|i) (?:\w+ )?(?:decline|refuse|pass on)", r"declin(?:e|ing) (?:this|the|to|your)", r"(?:guidelines|rules|policy|policies|instructions) (?:do not|don't|forbid|prevent|prohibit)",
        r"(?:outside|beyond) (?:of )?(?:what|my)", r"against my (?:rules|guidelines|policy|instructions)", r"not something i (?:complete|do|can)", r"would not be appropriate", r"ongoing contest", r"(?:on your own|yourself) and come back",
        r"please (?:consult|ask|contact) (?:your|a|an)", r"(?:i|we) (?:am|are) not (?:allowed|permitted|able)",
        r"ablehnen|lehne (?:\w+ ){0,3}ab", r"widerspricht meinen", r"wende dich|wenden sie sich", r"nicht erlaubt",
        r"décliner|refuser|refuse de", r"m'interdisent|m'interdit", r"pas autorisée?", r"veuillez consulter",
        r"rechazar|me niego", r"no me (?:permiten|permite|está permitido)", r"consulte por favor|por favor consulte", r"en lugar de otras personas",
        r"отклонить|отказать\w*|отказываюсь", r"не разрешают|нельзя мне|мне нельзя", r"обратитесь к",
        r"devo (?:rifiutare|declinare)|mi rifiuto", r"devo recusar|recuso", r"拒绝|拒絕|お断り",
    ],
    "regret": [
        r"thanks|thank you|danke|merci|gracias|спасибо|grazie|obrigad[oa]", r"sorry|apolog\w*|unfortunately|sadly|regrettably|regret|afraid", r"leid|leider|bedauere|bedaure|bedaurerlicherweise|entschuldig\w*", r"désolée?|malheureusement|regrette|regret", r"siento|lamento|lamentablemente|desgracia|desgraciadamente|disculpa\w*",
        r"извините|простите|сожалению|увы", r"mi dispiace|purtroppo|spiacente", r"desculpe|infelizmente|lamento", r"抱歉|对不起|對不起|申し訳|すみません",
    ],
    "speaker": [r"i|me|my|we|us|our", r"ich|mir|mich|mein\w*|wir|uns", r"je|j'|moi|m'|mon|mes|nous", r"yo|mi|mis|me|puedo|debo|podemos|doy|ayudo|resuelvo", r"я|мне|меня|мой|моя|мои|моих|мы|нам|могу", r"io|mi|posso|mia|mio", r"eu|posso|meu|minha", r"我|私"],
    "negation": [
        r"not|no|never|cannot|can't|won't|don't|unable|\w+n't|rather not", r"nicht|kein\w*|nie|niemals", r"ne|n'|pas|impossible|sans|ni", r"no|nunca|ningun\w*|tampoco|imposible", r"не|нет|ни|нельзя|никогда|невозможно", r"non|nessun\w*|mai", r"não|nunca|nenhum\w*",
        r"不|无法|無法|没|ません|ない",
    ],
    "offer": [
        r"help\w*|answer\w*|assist\w*|provid\w*|solution\w*|solv\w*|cod(?:e|es|ing)|program\w*|complet\w*|compl(?:y|ies)|homework|exercise\w*|assignment\w*|request\w*|task\w*|contest\w*|shar(?:e|ing)|write|writing",
        r"helfe\w*|hilfe|hilft|antwort\w*|beantwort\w*|lösung\w*|löse\w*|code|programm\w*|aufgabe\w*|hausaufgabe\w*|anfrage\w*|frage\w*|schreib\w*|angeb\w*|dienen|weiterhelfen",
        r"aid\w*|réponse\w*|répond\w*|solution\w*|résou\w*|code|programme|devoirs?|exercice\w*|demande\w*|fournir|donner|écri\w*|question\w*",
        r"ayud\w*|respuesta\w*|respond\w*|solución|soluciones|resolv\w*|resuelv\w*|código|programa\w*|tarea\w*|ejercicio\w*|solicitud|petición|pregunta\w*|dar\w*|ofrecer|proporcionar|escribir",
        r"помо\w*|ответ\w*|решени\w*|решать|решить|код\w*|программ\w*|задани\w*|запрос\w*|вопрос\w*|дать|написать|выполн\w*",
        r"aiut\w*|rispo\w*|soluzion\w*|risolv\w*|codice|compit\w*|richiesta", r"ajud\w*|respo\w*|soluç\w*|resolv\w*|código|tarefa\w*|pedido", r"帮|幫|回答|解答|提供|代码|解决|手伝|答え|解く|コード",
    ],
}


def _role(name: str) -> re.Pattern:
    spaced = "|".join(p for p in ROLES[name] if not re.search(r"[\u3040-\u9fff]", p))
    joined = "|".join(p for p in ROLES[name] if re.search(r"[\u3040-\u9fff]", p))
    # An elided word (n', m', j') is followed by the next one at once.
    return re.compile(rf"(?<!\w)(?:{spaced})(?:(?!\w)|(?<='))" + (f"|{joined}" if joined else ""), re.I)


_ROLES = {name: _role(name) for name in ROLES}
_SENTENCE = re.compile(r"[^.!?。！？\n]+(?:[.!?。！？]+|\n|$)")
_CODE_LIKE = re.compile(r"```|~~~|^\s*(?:def |for |while |import |print\()", re.M)


def declines(sentence: str) -> bool:
    """Does a sentence decline to answer?"""
    if _ROLES["refuse"].search(sentence):
        return True
    if not (_ROLES["negation"].search(sentence) and _ROLES["offer"].search(sentence)):
        return False
    return bool(_ROLES["speaker"].search(sentence) or _ROLES["regret"].search(sentence))


def is_refusal(text: str) -> bool:
    """Declines to answer and offers no solution: without code, one of its first two sentences declines, and half of all do or are mere regret.

    A sentence of one or two words ("No.") says neither.
    """
    if _CODE_LIKE.search(text):
        return False
    plain = re.sub(r"</?think>", " ", text).replace("’", "'").strip()
    sentences = [s for s in _SENTENCE.findall(plain) if len(s.split()) > 2 or not s.isascii()]
    said = [declines(s) for s in sentences]
    regrets = [bool(_ROLES["regret"].search(s)) for s in sentences]
    return any(said[:2]) and 2 * sum(a or b for a, b in zip(said, regrets)) >= len(sentences)


#: Share of a response's three-word sequences that stand in the prompt, from which it is a copy.
COPIED = 0.6


def _sequences(text: str) -> set[tuple[str, str, str]]:
    words = WORD.findall(text.lower())
    return set(zip(words, words[1:], words[2:]))


def copied_share(response: str, prompt: str) -> float:
    """Share of the response's three-word sequences that occur in the prompt, whatever the layout."""
    own = _sequences(re.sub(r"</?think>", " ", response))
    return len(own & _sequences(prompt)) / len(own) if own else 0.0


def wrong_language(response: str, prompt: str, model: LanguageModel) -> bool:
    """The explanation is clearly in one language and the prompt clearly in another."""
    told = model.language(response)
    if told is None:
        return False
    asked = model.language(prompt)
    return asked is not None and told != asked
