"""Own text of a post, its passages, and their statistics."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Mapping

from tallywise.llm.markup import plain

_QUOTE_TAG = re.compile(r"\[(/?)quote(?:=[^\[\]]*)?\]|<(/?)blockquote\b[^<>]*>", re.I)
_QUOTED_LINE = re.compile(r"^[ \t]*>")
_SAYS = re.compile(r"^(?:On \S+ )?\S+ (?:wrote|said|schrieb|escribió|a écrit) ?:\s*$|^(?:Am|El|Le) .{0,40}:\s*$")
_SIGN = re.compile(r"^(?:-- ?|={5,}|_{5,}|-{5,}|\*{5,}|~{3,})$|^<hr ?/?>", re.I)
_SIGN_LINE = re.compile(r"^(?:~\S+~|\[size=1\].*\[/size\]|(?:sent from|gesendet von|enviado desde|envoyé de) .{0,60})$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•–+]\s+|\(?\d{1,3}[.)]\s+|\(?[a-z][.)]\s+|\[[ xX]\]|<li\b|</?[uo]l>)", re.I)
_GAP = re.compile(r"\S {2,}\S")
_CELL = re.compile(r"</?t[drh]\b|</?table\b", re.I)
_FRAME = re.compile(r"^\+[-+]+\+$")
_PAIR = re.compile(r"^[^:.!?]{1,40}: ?\S+(?: \S+){0,9}$")
_ITEM_HEAD = frozenset("-*•–+([<")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_STOPS = frozenset(".!?…:;")
_SYMBOL = re.compile(r"[^\w\s]|_")


def own_text(text: str) -> str:
    """Without quoted text (tags, ``>`` lines and who said it) and signature.

    Quote tags may nest; a tag without partner is dropped by itself.
    """
    out, depth, at, held = [], 0, 0, []
    opens = list(_QUOTE_TAG.finditer(text))
    closing = sum(1 for m in opens if m[1] or m[2])
    for m in opens:
        if not depth:
            out.append(text[at : m.start()])
        if m[1] or m[2]:
            closing -= 1
            if depth:
                depth -= 1
            at = m.end()
        elif closing > depth:
            depth += 1
        at = m.end() if not depth else at
    if not depth:
        out.append(text[at:])
    lines = "\n".join(out).split("\n")
    keep: list[str] = []
    for i, line in enumerate(lines):
        if _QUOTED_LINE.match(line):
            continue
        nxt = next((x for x in lines[i + 1 :] if x.strip()), "")
        if _SAYS.match(line) and (_QUOTED_LINE.match(nxt) or held):
            continue
        keep.append(line)
    while keep and not keep[-1].strip():
        keep.pop()
    # A signature starts at the last mark with a few lines after it.
    for k in range(len(keep) - 1, max(-1, len(keep) - 6), -1):
        if _SIGN.match(keep[k].strip() if keep[k].strip() else keep[k]) and k > 0:
            keep = keep[:k]
            break
    while keep and (not keep[-1].strip() or _SIGN_LINE.match(keep[-1].strip())):
        keep.pop()
    return "\n".join(keep).strip("\n")


#: Evidence of a common word of which no labels speak.
NEUTRAL = 1.0


class Lexicon:
    """Common words of the languages, and how far each speaks for sentences.

    ``weights`` maps (language, word) to that evidence; a word without one has NEUTRAL.
    """

    def __init__(self, rows: Iterable[tuple[str | None, str | None]], weights: Mapping[tuple[str, str], float] | None = None):
        common: dict[str, set[str]] = {}
        for lang, word in rows:
            if lang and word:
                common.setdefault(lang, set()).add(word.casefold())
        self.langs = sorted(common)
        weights = weights or {}
        #: word -> ((language, evidence), ...)
        self.marks = {w: tuple((i, weights.get((k, w), NEUTRAL)) for i, k in enumerate(self.langs) if w in common[k]) for w in set().union(*common.values())}

    def count(self, words: Counter[str]) -> tuple[list[int], list[float]]:
        """Common words and their evidence, by language."""
        get = self.marks.get
        common, speaks = [0] * len(self.langs), [0.0] * len(self.langs)
        for w, n in words.items():
            for i, x in get(w, ()):
                common[i] += n
                speaks[i] += n * x
        return common, speaks


def blocks(text: str) -> list[list[str]]:
    """Runs of lines between blank lines."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if line and not line.isspace():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [b for b in out if b]


def _size(text: str) -> int:
    return len("".join(text.split()))


def _ends(line: str) -> bool:
    """Whether a line ends in punctuation, closing quotes and brackets aside."""
    return line.rstrip().rstrip("\"'»)]")[-1:] in _STOPS


def _words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def _is_item(line: str) -> bool:
    """Whether a line begins like an item of a list."""
    x = line.lstrip()
    return bool(x) and (x[0] in _ITEM_HEAD or x[0].isdigit() or x[1:2] in (".", ")")) and _ITEM.match(line) is not None


def _is_row(line: str) -> bool:
    """Whether a line looks like a row of a table: cells between tabs, bars, wide gaps or tags, frames, values after each comma or semicolon, a name and its value."""
    return (
        "\t" in line
        or line.count("|") > 1
        or ("  " in line and _GAP.search(line) is not None)
        or ("<" in line and _CELL.search(line) is not None)
        or ("," in line and ", " not in line)
        or (";" in line and "; " not in line and ";;" not in line and line[-1] != ";")
        or not line.strip("-| :")
        or (line[0] == "+" and _FRAME.match(line) is not None)
        or (":" in line and _PAIR.match(line) is not None)
    )


def _runs(own: str) -> Iterable[tuple[str, list[str]]]:
    """Runs of lines of one kind (item, table or text) within blocks."""
    for block in blocks(own):
        kind, run = None, []
        for line in block:
            shape = html.unescape(line) if "&" in line else line
            k = "item" if _is_item(shape) else "table" if _is_row(shape) else "text"
            if run and k != kind:
                yield kind, run
                run = []
            kind = k
            run.append(line)
        yield kind, run


#: Statistics of a passage. Evidence and common words are those of the language that has most; a mark is a character neither of a word nor blank.
STATS = ("evidence", "common_share", "mean_word", "symbol_share", "ended_share", "digit_share", "words_a_line", "letter_share", "capital_share", "distinct_share")
#: Figures of a text.
FIGURES = ("words", "mean_word", "symbol_share", "ended_share", "common_share")


def passage(lines: list[str], lex: Lexicon) -> tuple[int, Counter[str], list[int], list[float]]:
    """(characters, words, common words by language, STATS) of a run of lines. White space isn't a character; shares over nothing are 0."""
    raw = "\n".join(lines)
    clean = plain(raw)
    words = _WORD.findall(clean.casefold())
    bag = Counter(words)
    common, speaks = lex.count(bag)
    n, size, k = len(words), _size(raw), len(lines)
    digits = letters = 0
    for w, c in bag.items():
        if w[0].isdigit():
            digits += c
        else:
            letters += c * len(w)
    m = n or 1
    stats = [
        max(speaks, default=0.0) / m,
        max(common, default=0) / m,
        letters / m,
        len(_SYMBOL.findall(raw)) / (size or 1),
        sum(map(_ends, lines)) / k,
        digits / m,
        n / k,
        letters / (size or 1),
        sum(map(str.isupper, [w[0] for w in clean.split()])) / m,
        len(bag) / m,
    ]
    return size, bag, common, stats


def passages(text: str | None, lex: Lexicon, hint: str | None = None) -> tuple[str | None, int, list[float], list[Counter[str]]]:
    """(language, characters, per passage its characters and STATS in one flat list, words of each) of the own text.

    A passage is a run of lines of one shape between blank lines. The language is
    that whose common words are the most frequent; among equals ``hint``, if it is
    one of them, else the first by name; None if there are no common words and no hint.
    """
    flat, bags, total, all_ = [], [], [0] * len(lex.langs), 0
    for _, lines in _runs(own_text(text)) if text else ():
        size, bag, common, stats = passage(lines, lex)
        flat += [size, *stats]
        bags.append(bag)
        all_ += size
        total = [x + y for x, y in zip(total, common, strict=True)]
    hint = (hint or "")[:2].lower()
    best = max(range(len(total)), key=lambda i: (total[i], lex.langs[i] == hint, -i)) if total else None
    lang = None if best is None or not (total[best] or lex.langs[best] == hint) else lex.langs[best]
    return lang, all_, flat, bags


def figures(text: str | None, lex: Lexicon) -> tuple:
    """FIGURES of the whole text, quoted text and signature included; 0 everywhere for a null or empty one.

    Common words are those of the language that has the most of them.
    """
    n = letters = ended = lines = 0
    common, size = [0] * len(lex.langs), _size(text) if text else 0
    if not size:
        return (0, 0.0, 0.0, 0.0, 0.0)
    for _, run in _runs(text):
        words = _words(plain("\n".join(run)))
        n += len(words)
        letters += sum(map(len, words))
        common = [x + y for x, y in zip(common, lex.count(Counter(words))[0], strict=True)]
        lines += len(run)
        ended += sum(map(_ends, run))
    return (n, letters / n if n else 0.0, len(_SYMBOL.findall(text)) / size, ended / lines, max(common, default=0) / n if n else 0.0)
