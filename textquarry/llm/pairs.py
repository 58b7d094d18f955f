"""Broken prompt and response pairs: clauses of the response are tagged by a conditional random field."""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.versions import AlreadyPublished, Versions
from ..plans.workspace import Workspace, shared_root
from .crf import Crf
from .pair_words import CUES, EXAMPLES, FILLER_HEADS, FILLER_WORDS, OPEN_ENDS, OTHER_LANGUAGES, PLACEHOLDERS, STOP_WORDS
from .tongues import Tongues, disguised, letter_groups

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
LANGUAGES = tuple(STOP_WORDS)
#: Pairs that a field is trained on together, on average or up to twice as many; answers longer than this are trained on in pieces.
BUCKET_ROWS, PIECE = 800, 2_000
#: Share of a response's characters that a tag must cover to make a defect of the pair.
COVERAGE = 0.5
#: Pairs that are tagged together; changes of what a model holds raise the version.
BATCH, VERSION = 512, 3
#: Steps of training.
ROUNDS = 80
_LEXICAL = 4096
#: Weights are added up as whole multiples of this, so that their sum doesn't depend on the order.
_GRAIN = 2.0**-20

_INVISIBLE = re.compile("[​‌‍⁠﻿­᠎‎‏‪-‮⁡-⁤͏ㅤᅟᅠ⠀]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ANYWORD = re.compile(r"[^\W_]+")
_FENCE = re.compile(r"^ {0,3}(```|~~~)", re.M)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"»”')\]]*\s+(?=\S)")
_CODE_SPAN = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"\"[^\"\n]{4,}\"|«[^»\n]{4,}»|“[^”\n]{4,}”|„[^“”\n]{4,}[“”]")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])(?:\s+|$)")
_HEADING = re.compile(r"^\s*#{1,6}\s*")
_MARK = re.compile(r"^[\s>#*_\"'“”«»„`-]+|[\s*_\"'“”«»]+$")
_LABEL = re.compile(r"^\W*(?:q|question|frage|pregunta|answer|antwort|réponse|respuesta|note|hinweis|nota|a|r)\b\s*[:*]", re.I)
_NUMBER = r"[-+]?\d[\d.,]*"
_VALUE = re.compile(rf"^(?:`[^`]+`|{_NUMBER}|[\w.-]+(?:/[\w.-]+)+|--?[\w-]+|\w*[_\d]\w*)(?:\s*(?:=|:|->)\s*(?:`[^`]+`|{_NUMBER}|\w+))?(?:\s*[^\W\d_]{{1,9}}\.?|%)?\.?$")
_CUES = {k: re.compile(v) for k, v in CUES.items()}
#: The cue that suffices to leave a short answer of the table out of training as a possible refusal.
_DECLINES = 1 << list(CUES).index("decline")
_STOP = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}
_OPEN = frozenset(OPEN_ENDS.split())
_PLACEHOLDERS = frozenset(PLACEHOLDERS)
_HEADS, _FILLER = frozenset(FILLER_HEADS.split()), frozenset(FILLER_WORDS.split())
_FOREIGN_LETTER = re.compile("[^\\W\\d_\u0000-\u024f]")
_FENCE_NAME = re.compile(r"^ {0,3}(?:```|~~~)\w*\n?")


def is_empty(answer: str | None) -> bool:
    """Null, or nothing but blanks, invisible characters, bare marks or a placeholder.

    A placeholder is one of a list, or up to eight words that say nothing but
    that something is to come or to be looked up elsewhere.
    """
    if answer is None:
        return True
    words = _ANYWORD.findall(_INVISIBLE.sub("", answer).lower())
    if not words:
        return True
    if len(words) > 8 or re.search(r"`\w+`", answer):
        return False
    return " ".join(words) in _PLACEHOLDERS or not _HEADS.isdisjoint(words) and all(w in _HEADS or w in _FILLER for w in words)


def clauses(answer: str) -> list[tuple[str, str]]:
    """``(kind, text)`` of the pieces of an answer: code blocks, headings, list items, quoted lines and sentences."""
    out: list[tuple[str, str]] = []

    def prose(text: str) -> None:
        for line in text.split("\n"):
            if not line.strip():
                continue
            kind = "heading" if _HEADING.match(line) and line.lstrip().startswith("#") else "item" if _ITEM.match(line) else "quoted" if line.lstrip().startswith(">") else "plain"
            if kind in ("heading", "item") and len(line) < 400:
                out.append((kind, line.strip()))
                continue
            out.extend((kind, s) for s in _SENTENCE.split(line.strip()) if s and s.strip())

    at = 0
    marks = [m.start(1) for m in _FENCE.finditer(answer)]
    for k in range(0, len(marks), 2):
        prose(answer[at : marks[k]])
        closed = k + 1 < len(marks)
        at = marks[k + 1] + 3 if closed else len(answer)
        out.append(("code" if closed else "open_code", answer[marks[k] : at]))
    prose(answer[at:])
    return out or [("plain", answer.strip())]


def pieces(answer: str) -> list[str]:
    """All of an answer, in pieces of some ``PIECE`` characters that end where a sentence or line does, and not in a code block."""
    if len(answer) <= PIECE:
        return [answer]
    out, held, size, fenced = [], [], 0, False
    for line in re.findall(r"[^\n]*\n|[^\n]+", answer):
        fence = bool(_FENCE.match(line))
        ends = [] if fence or fenced else [m.end() for m in _SENTENCE.finditer(line) if not line.startswith(("```", "~~~"), m.end())]
        fenced ^= fence
        for a, b in zip([0, *ends], [*ends, len(line)]):
            held.append(line[a:b])
            size += b - a
            if size >= PIECE and not fenced:
                out.append("".join(held))
                held, size = [], 0
    return out + ["".join(held)] if size else out


def plain(text: str) -> str:
    """Text without code spans and quotations, in lower case."""
    return _QUOTED.sub(" ", _CODE_SPAN.sub(" ", text)).lower()


def _grams(text: str) -> Counter:
    t = " ".join(_ANYWORD.findall(text.lower()))
    return Counter(t[i : i + 3] for i in range(len(t) - 2))


def _cues(word: str) -> int:
    """What a word may express in a refusal, by itself or by a part before or behind an apostrophe; a bit for each of ``CUES``."""
    forms = {word, *re.split("['’]", word)}
    return sum(1 << i for i, p in enumerate(_CUES.values()) if any(p.fullmatch(w) for w in forms))


#: Names of the features of each set of cues.
_told_names: dict[int, tuple[str, ...]] = {}


def _told(cues: int) -> tuple[str, ...]:
    found = _told_names.get(cues)
    if found is None:
        told = [k for i, k in enumerate(CUES) if cues >> i & 1]
        pairs = (f"cues {a}+{b}" for i, a in enumerate(told) for b in told[i + 1 :])
        found = _told_names[cues] = (*(f"cue {k}" for k in told), *pairs, f"cues={min(6, len(told))}")
    return found


class Model:
    """Languages, lexicon and random field; what the workers need. Only the lexicon grows, with the vocabulary."""

    def __init__(self) -> None:
        self.lexicon: dict[str, np.ndarray] = {}
        self.tongues: Tongues | None = None
        self._words: dict[str, tuple] = {}
        self.names: dict[str, int] = {}
        self.crf: Crf | None = None
        self._asked: dict = {}

    # languages

    def learn_languages(self, texts: list[tuple[str, str]]) -> None:
        """``texts``: (language, text)."""
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        for lang, text in texts:
            for w in set(_WORD.findall(plain(text))):
                counts[w][LANGUAGES.index(lang)] += 1
        self.learn_words(counts.items(), sum(counts.values(), np.zeros(len(LANGUAGES))))

    def learn_words(self, counts: Iterable[tuple[str, np.ndarray]], total: np.ndarray) -> None:
        """``counts``: in how many texts of each language a word is. Log odds of each word; stop words count as certain.

        A word not seen in a language counts as equally rare in each, however much text there is of it.
        """
        self._words.clear()
        unseen = 0.3 * len(LANGUAGES) / (total + 1).sum()
        for w, c in counts:
            if c.sum() >= 3 and len(w) > 1:
                p = c / (total + 1) + unseen
                if p.max() > 6 * np.sort(p)[-2] or p.min() < 0.05 * p.max():
                    self.lexicon[w] = np.clip(np.log(p / p.max()), -4, 0)
        for k, words in _STOP.items():
            for w in words:
                own = np.asarray([0.0 if w in _STOP[x] else -3.0 for x in LANGUAGES])
                self.lexicon[w] = np.minimum(own, self.lexicon.get(w, own))

    def _word(self, word: str) -> tuple:
        """``(language scores or None, how much likelier the word is in no known language than in each or None, cues, hash or -1)``"""
        lexical = self.lexicon.get(word)
        odd = None
        if self.tongues is not None and len(word) > 1:
            p = self.tongues.word(word)
            odd = tuple(p[-1] - x for x in p[:-1])
        known = lexical is not None or len(word) > 1 and word in _OPEN
        found = (None if lexical is None else tuple(map(float, lexical)), odd, _cues(word), zlib.crc32(word.encode()) % _LEXICAL if known else -1)
        if len(self._words) >= 200_000:
            self._words.clear()
        self._words[word] = found
        return found

    def records(self, words: list[str]) -> list[tuple]:
        get, make = self._words.get, self._word
        return [get(w) or make(w) for w in words]

    def language(self, text: str) -> tuple[str | None, float]:
        """Best language of the prose in a text and its lead over the next; None if nothing tells, or if it is none of those known."""
        records = self.records(_WORD.findall(plain(text)))
        lang, lead = self._language(records)
        return (None, 0.0) if lang and self.strange(records, lang)[0] > 8 else (lang, lead)

    @staticmethod
    def _language(records: list[tuple]) -> tuple[str | None, float]:
        held = [r[0] for r in records if r[0] is not None]
        if not held:
            return None, 0.0
        s = [sum(x) for x in zip(*held)]
        second, first = sorted(s)[-2:]
        return (LANGUAGES[s.index(first)], first - second) if first - second > 2 else (None, 0.0)

    @staticmethod
    def strange(records: list[tuple], lang: str) -> tuple[float, int]:
        """By how much the words are likelier in a language not known than in ``lang``, and how many of them tell."""
        k = LANGUAGES.index(lang)
        held = [r[1][k] for r in records if r[1] is not None]
        return sum(held), len(held)

    # features

    def _id(self, name: str) -> int:
        if self.crf is None:
            return self.names.setdefault(name, len(self.names) + _LEXICAL)
        return self.names.get(name, -1)

    def features(self, question: str | None, answer: str) -> tuple[list[list[int]], list[int], list[str], list[bool]]:
        """Feature numbers, size and kind of each clause, and whether it has much of the question."""
        parts = clauses(answer)
        q = question or ""
        if self._asked.get("question") != q or len(self._asked["seen"]) > 10_000:  # clauses of made pairs come again and again under their question
            self._asked = {"question": q, "words": Counter(_ANYWORD.findall(q.lower())), "grams": None, "lang": self.language(q)[0] if q else None, "seen": {}}
        seen = self._asked["seen"]
        units, sizes, echoes = [], [], []
        for n, (kind, text) in enumerate(parts):
            key = kind, text, n == len(parts) - 1, "alone" if len(parts) == 1 else "first" if n == 0 else "later"
            found = seen.get(key) or seen.setdefault(key, self._clause(*key))
            for x, to in zip(found, (units, sizes, echoes)):
                to.append(x)
        return units, sizes, [k for k, _ in parts], echoes

    def _clause(self, kind: str, text: str, last: bool, place: str) -> tuple[list[int], int, bool]:
        """Feature numbers and size of a clause under the question at hand, and whether it has much of it."""
        q, q_words, q_grams, q_lang = (self._asked[k] for k in ("question", "words", "grams", "lang"))
        names = ["bias", f"kind={kind}"]
        code = kind in ("code", "open_code")
        core = _MARK.sub("", _LABEL.sub("", text))
        words = _ANYWORD.findall(text.lower())
        prose = "" if code else plain(_FENCE_NAME.sub("", text))
        cased = _WORD.findall(prose)
        # the question given back
        same = sum(min(1, q_words[w]) for w in words) / max(1, len(words)) if q_words and not code else 0.0
        echo = same > 0.5
        value = kind in ("plain", "quoted") and bool(_VALUE.match(core.strip())) or not cased
        if value:
            names.append("value")
        elif q_words and not code:
            inside = covered = 0.0
            if same > 0.2 or len(words) < 4:
                q_grams = self._asked["grams"] = q_grams or _grams(q)
                g = _grams(core)
                both = sum((g & q_grams).values())
                inside, covered = both / max(1, g.total()), both / max(1, q_grams.total())
            names += [f"echo_in>{b}" for b in (0.5, 0.65, 0.8, 0.9) if inside > b]
            names += [f"echo_of>{b}" for b in (0.3, 0.5, 0.65, 0.8) if covered > b]
            names += [f"echo_words>{b}" for b in (0.5, 0.7, 0.85) if same > b]
            fresh = sum(w not in q_words for w in words)
            names += [f"fresh>{b}" for b in (0, 1, 2, 4) if fresh > b]
            if any(x.strip("`") not in q for x in _CODE_SPAN.findall(text)):
                names.append("fresh code")
            echo = inside > 0.5 or covered > 0.5 or same > 0.5
            if inside > 0.6 and covered > 0.5:
                names.append("echo")
            elif inside < 0.5 and covered < 0.5:
                names.append("own words")
            if core.rstrip(" \"'»”*_").endswith(("?", "？")):
                names.append("asks")
        # language
        records = self.records(cased)
        lang, lead = self._language(records)
        if q_lang:
            odd, telling = self.strange(records, q_lang)
            names += [f"strange>{b}" for b in (-8, -2, 0, 3, 8, 16) if telling and odd > b]
            names += [f"strange each>{b}" for b in (-1, -0.3, 0, 0.5, 1, 2) if telling and odd > b * telling]
            names += [f"telling>{b}" for b in (2, 5) if telling > b]
            if len(_FOREIGN_LETTER.findall(prose)) * 2 > len(prose.replace(" ", "")):
                names.append("other script")
            if telling > 4 and not any(w in _STOP[q_lang] for w in cased):
                names.append("no stop words")
        if lang and q_lang:
            names += ["other language" if lang != q_lang else "own language"]
            names += [f"{'other' if lang != q_lang else 'own'}>{b}" for b in (4, 8, 16) if lead > b]
        elif not lang:
            names.append("no language")
        # refusing
        cues = 0
        for record in records:
            cues |= record[2]
        names += _told(cues)
        if "`" in text:
            names.append("has code")
        # ending
        if last:
            names += ["last", f"last kind={kind}", *(f"last {x}" for x in self._ending(kind, text, cased))]
        if kind == "heading":
            names.append("heading last" if last else "heading inside")
        names.append(f"long={min(5, len(words) // 4)}")
        names.append(place)
        ids = [i for i in map(self._id, names) if i >= 0]
        before, follows = "^", True
        for b, record in zip(cased, records):
            if record[3] >= 0:
                ids.append(record[3])
                if follows:
                    ids.append(zlib.crc32(f"{before} {b}".encode()) % _LEXICAL)
            before, follows = b, record[0] is not None
        return ids, max(1, len(words)) if kind != "heading" else 1, echo

    def _ending(self, kind: str, text: str, words: list[str]) -> list[str]:
        out = []
        bare = text.rstrip()
        if kind == "code":
            return ["closed"]
        if kind == "open_code":
            return ["open block"]
        stripped = _ITEM.sub("", _HEADING.sub("", text.strip()).strip() if kind == "heading" else text).strip()
        stripped = stripped.lstrip("> ")
        if not _ANYWORD.search(stripped):
            return ["marks only"]
        outside = _CODE_SPAN.sub("", bare)
        tail = bare.rstrip("\"'»”*_)")
        if bare.count("`") % 2:
            out.append("open code")
        if outside.count("(") > outside.count(")") or outside.count("[") > outside.count("]"):
            out.append("open bracket")
        if _QUOTED.sub("", outside).count('"') % 2:
            out.append("open quote")
        out += ["open"] * bool(out)
        value = bool(_VALUE.match(stripped))
        if value:
            out.append("value")
        if tail.endswith((".", "!", "?", "…", "。", "！", "？", "।", "؟")):
            out.append("stop")
        elif bare.endswith(":"):
            out.append("colon")
        elif bare.endswith((",", ";", "(", "[", "{", "-", "–", "/", "=", "_", "'")):
            out.append("goes on")
        elif not value:
            out.append("no stop")
            final = _ANYWORD.findall(bare.lower())
            if final and final[-1] in _OPEN:
                out.append("open word")
            out.append("no stop, code" if bare.endswith("`") else "no stop, word")
        return out

    # tags and defects

    def defects(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        """The defect of each pair, from how much of the answer its clauses' tags cover."""
        out: list[str | None] = ["empty" if is_empty(a) else None for _, a in pairs]
        todo = [i for i, d in enumerate(out) if d is None]
        made = [self.features(pairs[i][0], _INVISIBLE.sub("", pairs[i][1])) for i in todo]
        for i, tags, (_, sizes, kinds, echoes) in zip(todo, self.crf.tag_all([m[0] for m in made]), made):
            out[i] = self._verdict(pairs[i][0], tags, sizes, kinds, echoes)
        return out

    def defect(self, question: str | None, answer: str | None) -> str | None:
        return self.defects([(question, answer)])[0]

    def _verdict(self, question: str | None, tags: list[int], sizes: list[int], kinds: list[str], echoes: list[bool]) -> str | None:
        total = sum(sizes)
        share = [sum(s for t, s in zip(tags, sizes) if t == k) / total for k in range(len(TAGS))]
        if tags[-1] == UNFINISHED:  # an answer breaks off where it ends, however much of it came before
            return "truncated"
        if share[REFUSAL] >= COVERAGE:
            return "refusal"
        if question is None:
            return None
        if share[ECHO] >= 1 - 0.15 and sum(s for t, s, e in zip(tags, sizes, echoes) if t == ECHO and e) >= COVERAGE * total:
            return "copy"
        spoken = [(t, s) for t, s, k in zip(tags, sizes, kinds) if k not in ("code", "heading")]
        foreign = sum(s for t, s in spoken if t == FOREIGN)
        if foreign >= COVERAGE * max(1, sum(s for _, s in spoken)) and self.language(question)[0]:
            return "language"
        return None


# Lines of code blocks in training pairs.
_CODE = (
    "def read(path, limit=20):", "    return open(path).read()", "    for row in rows:", "        print(row)", '    """Rows of a table."""', "x = load('a', 3)",
    "if size is None or size > 40:", '    raise ValueError("too large")', "# the limit is checked first", "make index", "    total = add(total, row[2])",
)


def _altered(q: str, r: Random) -> str:
    """A question given back, changed a little or marked."""
    words = q.split(" ")
    how = r.randrange(9)
    if how == 0 and len(words) > 4:
        del words[r.randrange(1, len(words) - 1)]
    elif how == 1:
        k = max(range(len(words)), key=lambda i: (words[i].isalpha(), r.random()))
        w = words[k]
        if len(w) > 2:
            i = r.randrange(len(w) - 1)
            words[k] = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    out = " ".join(words)
    if how == 2:
        out = out.upper()
    elif how == 3:
        out = out.lower()
    elif how == 4:
        out = out.rstrip(" ?.")
    elif how == 5:
        out = "  ".join(words) + " \n"
    mark = r.randrange(9)
    if mark < 6:
        out = ["> {}", "## {}", "Q: {}", "Question: {}", '"{}"', "**{}**"][mark].format(out)
    elif mark == 6:
        out = out + r.choice(["\n", " ", "\n\n"]) + q
    return out


def training_pairs(rows: list[tuple[str, str]], model: Model, seed: int = 7):
    """``(question, answer, tag of the last clause, tags of the others by kind)`` made from real and example pairs.

    Real answers that look whole are kept as they are; and cut, put under a
    question of another language, or replaced by their question. Refusals and
    statements about limits come from the examples. Answers of up to 220
    characters with cues of three kinds, or one of declining, may be refusals and
    are left out; in longer ones the cues don't count.
    """
    r = Random(seed)
    by_lang: dict[str, list[tuple[str, str]]] = defaultdict(list)
    names = ["alpha_read", "BetaScan", "--gamma-limit", "delta.load"]
    for q, a in rows:
        lang = model.language(q)[0]
        whole = a.rstrip().endswith((".", "`")) and len(a) > 30 and len(_FENCE.findall(a)) % 2 == 0
        clean = not (_grams(clauses(a)[0][1]) & _grams(q)).total() > 0.6 * max(1, _grams(q).total())
        said = 0
        for record in model.records(_WORD.findall(plain(a))):
            said |= record[2]
        hits = 3 if said & _DECLINES else said.bit_count()
        if lang and whole and clean and (hits < 3 or len(a) > 220) and model.language(a)[0] in (None, lang):
            by_lang[lang].append((q, a))
    for lang, ex in EXAMPLES.items():
        for q in ex["questions"]:
            by_lang[lang].extend((q, " ".join(r.sample(ex["answers"], k))) for k in (1, 1, 1, 2, 2, 3, 3, 4))
    for lang in LANGUAGES:
        ex, own = EXAMPLES[lang], by_lang[lang]
        others = [p for x in LANGUAGES if x != lang for p in by_lang[x]]
        for q, a in own:
            word = r.choice(_ANYWORD.findall(q.lower()) or ["it"])
            yield q, a, ANSWER, ANSWER
            if r.random() < 0.4:
                yield q, r.choice(ex["leads"]) + a, ANSWER, ANSWER
            if r.random() < 0.5 and "```" not in a:
                code = f"{a}\n\n```{r.choice(['python', '', 'sh'])}\n" + "\n".join(r.sample(_CODE, r.randrange(1, 5))) + "\n```"
                yield q, code, ANSWER, ANSWER
                opened = code.index("```")
                yield q, code[: r.randrange(opened + 3, len(code) - 3)], UNFINISHED, ANSWER
            for _ in range(2):
                cut = a[: r.randrange(min(len(a) - 1, 8), len(a))].rstrip()
                if r.random() < 0.35:
                    ends = [m.end() for m in re.finditer(r"\.\s", a + " ")]
                    cut = a[: r.choice(ends)].rstrip() if ends else cut
                    cut += r.choice(["\n- ", "\n* ", "\n1. ", " (", " - ", "\n\n## " + r.choice(["Notes", "Limits", "Details", "Hinweise", "Notas"]), "\n- " + a[: r.randrange(3, 20)], "\n- " + r.choice(others or own)[1][: r.randrange(3, 20)], ",", " " + a[:25] + ",", " `", *(x + r.choice(["see", "siehe", "voir", "vea", r.choice(_ANYWORD.findall(a))]) + " `" + "name"[: r.randrange(4)] for x in (" - ", " ("))])
                elif r.random() < 0.3:
                    cut = " ".join(cut.split(" ")[:-1]) + " " + r.choice(OPEN_ENDS.split())
                ends = clauses(cut)[-1][1].rstrip() if cut.strip() else ""
                done = ends.endswith((".", "!", "?")) and cut.count("```") % 2 == 0 and "." in ends[-2:] and not cut.endswith((" (", "-"))
                if cut.strip() and not done and not (_VALUE.match(cut) and "\n" not in cut) and cut != a.rstrip() and cut.rstrip() != a.rstrip().rstrip("`") and not is_empty(cut):
                    listed = clauses(cut)[-1][0] == "item" and cut.endswith("`")
                    if not listed and clauses(cut)[-1][0] != "code":
                        yield q, cut, UNFINISHED, ANSWER
            if others:
                f = r.choice(others)[1]
                yield q, f, FOREIGN, FOREIGN
            spoken = " ".join(s for k, s in clauses(a) if k == "plain" and "`" not in s) or r.choice(ex["answers"])
            yield q, disguised(spoken, r), FOREIGN, FOREIGN
            if r.random() < 0.5:
                yield q, " ".join(r.sample(OTHER_LANGUAGES, r.randrange(1, 3))), FOREIGN, FOREIGN
            yield q, _altered(q, r), ECHO, ECHO
            yield q, q + r.choice(["\n", "\n\n", " "]) + a, ANSWER, (ECHO, ANSWER)
            for _ in range(2):
                if "inverted" in ex and r.random() < 0.5:
                    text = r.choice(ex["openers"][1:]) + r.choice(ex["inverted"])
                else:
                    core = r.choice(ex["refusals"])
                    opener = r.choice(ex["openers"]) if lang != "de" else ""
                    text = opener + (core[0].lower() + core[1:] if opener and not core.startswith(("I ", "I'")) else core)
                text = (text + r.choice(ex["tails"])).format(x=word) + r.choice([".", ".", "", "!"])
                yield q, r.choice(["{}", "{}", "{}", "# Answer\n\n{}", "> {}", "**Note** {}"]).replace("{}", text), REFUSAL, REFUSAL
            for limit in r.sample(ex["limits"], 2):
                limit = limit.format(x=word.capitalize() if r.random() < 0.5 else word, y=r.choice(names))
                yield q, limit + (" " + a if r.random() < 0.4 else ""), ANSWER, ANSWER
            if others:
                said = [s for k, s in clauses(r.choice(others)[1]) if k == "plain"] or ["ok"]
                quote = r.choice(ex["quotes"]).replace("{q}", said[0].replace('"', ""))
                yield q, r.choice([quote, f"{a} {quote}" if "\n" not in a else quote, f"{quote} {a}"]), ANSWER, ANSWER
            known = [x.strip("`") for x in _CODE_SPAN.findall(q)] or names
            value = r.choice([f"`{r.choice(known)}`", f"`{r.choice(known)}` = {r.randrange(900)}"] if r.random() < 0.4 else [f"{r.randrange(4000)} {u}" for u in ("ms", "s", "KiB", "MiB", "rows", "pages", "Zeilen", "lignes", "filas", "entries")] + [f"`{r.choice(names)}`", f"`{r.choice(names)}` = {r.randrange(900)}", f"`core/io/{word}.py`", f"core/io/{word}.md"])
            yield q, value + r.choice(["", "."]), ANSWER, ANSWER
            items = "\n".join(f"{r.choice('-*')} `{r.choice(names + known)}`" for _ in range(r.randrange(2, 6)))
            yield q, r.choice(ex["lists"]) + "\n" + items, ANSWER, ANSWER


def _examples() -> list[tuple[str, str]]:
    """(language, text) of all examples."""
    return [(lang, t) for lang, ex in EXAMPLES.items() for key in ("questions", "answers", "refusals", "limits", "lists", "leads") for t in ex[key] * 3]


def _first() -> Model:
    """What tells languages before anything is learned from a table."""
    model = Model()
    model.learn_languages(_examples())
    return model


def _spoken(first: Model, q: str, a: str, begins: bool) -> Iterator[tuple[str, str]]:
    """(language, text) of a question, with the first piece of its answer, and of the sentences that may be in its language."""
    lang = first.language(q)[0]
    if lang:
        if begins:
            yield lang, q
        yield from ((lang, s) for k, s in clauses(a) if k == "plain" and first.language(s)[0] in (None, lang))


#: In how many texts a word is, and how often, by the number of the language and the word; the number after the last is the language of no one.
Tally = dict[tuple[int, str], list[int]]


def _count(tally: Tally, texts: Iterable[tuple[str, str]], under: str = "") -> None:
    """Counts the words of each text, and those of the same text with letters exchanged, otherwise under another question."""
    for i, (lang, text) in enumerate(texts):
        prose = plain(text)
        strange = disguised(prose, Random(zlib.crc32(f"{i} {under} {text}".encode("utf-8", "surrogatepass"))))
        for k, t in ((LANGUAGES.index(lang), prose), (len(LANGUAGES), strange)):
            for w, n in Counter(_WORD.findall(t)).items():
                held = tally[k, w]
                held[0] += 1
                held[1] += n


def _tally() -> Tally:
    return defaultdict(lambda: [0, 0])


def _examples_tally() -> Tally:
    tally = _tally()
    _count(tally, _examples())
    for t in OTHER_LANGUAGES:
        for w in _WORD.findall(t.lower()):
            tally[len(LANGUAGES), w][1] += 1
    return tally


def _learned(words: Iterable[tuple[str, np.ndarray]], total: np.ndarray, groups: Iterable[tuple[int, str, str, int]]) -> Model:
    """Languages from the words of known languages and the letter groups of all; the field is still to be trained."""
    model = _first()
    model.learn_words(words, total)
    model.tongues = Tongues([*LANGUAGES, "other"], groups)
    return model


def _trained(learned: Model, rows: list[tuple[str, str]], bucket: int) -> dict[str, np.ndarray]:
    """Weights of a field trained on pairs made from ``rows``, by feature: for each tag, times the feature's occurrences, in grains; then these."""
    model = Model()
    model.lexicon, model.tongues, model._words = learned.lexicon, learned.tongues, learned._words
    sequences = []
    for q, a, last, rest in training_pairs(rows, model, 7 + bucket):
        units, _, kinds, _ = model.features(q, a)
        first, later = rest if isinstance(rest, tuple) else (rest, rest)
        tags = [first, *[later] * (len(units) - 1)]
        tags = [ANSWER if t == FOREIGN and k == "code" else t for t, k in zip(tags, kinds)]
        tags[-1] = last if not (last == FOREIGN and kinds[-1] == "code") else ANSWER
        sequences.append((units, tags))
    size = _LEXICAL + len(model.names)
    theta = Crf(len(TAGS), size).fit(sequences, ROUNDS).theta
    n = np.bincount(np.fromiter((i for units, _ in sequences for u in units for i in u), np.int64), minlength=len(theta))
    n[size:] = len(sequences)
    names = [f"#{i}" for i in range(_LEXICAL)] + list(model.names) + [f"tag {i}" for i in range(len(TAGS) + 2)]
    grains = np.rint(theta / _GRAIN).astype(np.int64) * n[:, None]
    return {name: np.append(grains[i], n[i]) for i, name in enumerate(names) if n[i]}


def _joined(learned: Model, sums: dict[str, np.ndarray]) -> Model:
    """The model whose weights are the mean over all buckets, each with the feature's occurrences there."""
    names = sorted(k for k in sums if not re.fullmatch(r"#\d+|tag \d+", k))
    learned.names = {k: _LEXICAL + i for i, k in enumerate(names)}
    learned.crf = Crf(len(TAGS), _LEXICAL + len(names))
    for i, k in enumerate([*(f"#{i}" for i in range(_LEXICAL)), *names, *(f"tag {i}" for i in range(len(TAGS) + 2))]):
        if k in sums:
            learned.crf.theta[i] = sums[k][:-1] / sums[k][-1] * _GRAIN
    return learned


def fit(rows: list[tuple[str, str]]) -> Model:
    """Model from (question, answer) pairs that are trained on together, here; the same for the same rows."""
    first, tally = _first(), _examples_tally()
    parts = sorted({(q, p, i == 0) for q, a in rows for i, p in enumerate(pieces(a))})
    for part in parts:
        _count(tally, _spoken(first, *part), part[0])
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
    groups: Counter[tuple[int, str, str]] = Counter()
    for (k, w), (texts, times) in tally.items():
        if k < len(LANGUAGES):
            counts[w][k] = texts
        for before, letter, n in letter_groups(w, times):
            groups[k, before, letter] += n
    learned = _learned(counts.items(), sum(counts.values(), np.zeros(len(LANGUAGES))), ((*g, n) for g, n in groups.items()))
    return _joined(learned, _trained(learned, sorted({p[:2] for p in parts}), 0))


def _fit_table(spark: SparkSession, parts: DataFrame, buckets: int) -> Model:
    """``fit`` in tasks, for all pieces of a table: counts of the whole table, then a field for each bucket of pieces by hash, then their mean."""
    ws = Workspace(spark, "pairs")
    try:
        first = spark.sparkContext.broadcast(_first())
        tallied = "lang int, word string, texts bigint, times bigint"

        def batch(tally: Tally) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"lang": k, "word": w, "texts": n, "times": m} for (k, w), (n, m) in tally.items()], pa.schema([("lang", pa.int32()), ("word", pa.string()), ("texts", pa.int64()), ("times", pa.int64())]))

        def count(batches):
            for b in batches:
                tally = _tally()
                for part in zip(*(b.column(c).to_pylist() for c in ("question", "piece", "begins"))):
                    _count(tally, _spoken(first.value, *part), part[0])
                yield batch(tally)

        def group(batches):
            schema = pa.schema([("lang", pa.int32()), ("before", pa.string()), ("letter", pa.string()), ("n", pa.int64())])
            for b in batches:
                groups: Counter[tuple[int, str, str]] = Counter()
                for k, w, times in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "times"))):
                    for before, letter, n in letter_groups(w, times):
                        groups[k, before, letter] += n
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*((*g, n) for g, n in groups.items())) if groups else [[]] * 4, schema)], schema=schema)

        tasks = max(spark.sparkContext.defaultParallelism, buckets // 64)
        told = parts.repartition(tasks, "question", "piece", "begins").distinct().mapInArrow(count, tallied)
        examples = spark.createDataFrame([(*k, *v) for k, v in _examples_tally().items()], tallied)
        words = ws.cut(told.unionByName(examples).groupBy("lang", "word").agg(F.sum("texts").alias("texts"), F.sum("times").alias("times")), "words")
        known = words.where(F.col("lang") < len(LANGUAGES))
        total = np.zeros(len(LANGUAGES))
        for lang, n in known.groupBy("lang").agg(F.sum("texts")).collect():
            total[lang] = n
        each = known.groupBy("word").agg(*(F.sum(F.when(F.col("lang") == k, F.col("texts")).otherwise(0)) for k in range(len(LANGUAGES))), F.sum("texts").alias("n")).where("n >= 3")
        counts = [(r[0], np.asarray(r[1:-1], float)) for r in each.collect()]
        groups = words.mapInArrow(group, "lang int, before string, letter string, n bigint").groupBy("lang", "before", "letter").agg(F.sum("n")).collect()
        learned = _learned(counts, total, map(tuple, groups))
        held = spark.sparkContext.broadcast(learned)

        def train(batches):
            rows: dict[int, set[tuple[str, str]]] = defaultdict(set)
            for b in batches:
                for k, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "question", "piece"))):
                    rows[k].add(tuple(row))
            for k in sorted(rows):
                found = _trained(held.value, sorted(rows[k]), k)
                columns = np.stack(list(found.values()), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *map(pa.array, columns)], names=["name", *(f"s{i}" for i in range(len(columns)))])

        sums = [f"s{i}" for i in range(len(TAGS) + 1)]
        bucket = F.pmod(F.xxhash64("question", "piece"), F.lit(buckets)).cast("int").alias("bucket")
        apart = parts.select(bucket, "question", "piece").repartitionById(buckets, F.col("bucket"))
        fields = apart.mapInArrow(train, ", ".join(["name string", *(f"{x} bigint" for x in sums)])).groupBy("name").agg(*(F.sum(x) for x in sums))
        return _joined(learned, {r[0]: np.asarray(r[1:], float) for r in fields.collect()})
    finally:
        ws.close()


def stored_model(spark: SparkSession, rows: DataFrame | list[tuple[str, str]]) -> Model:
    """The model of these (question, answer) rows, all of them, trained once: it is kept in the shared folder by a hash of the rows and of this code's parameters."""
    table = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, "question string, answer string")

    def cut(batches):
        for b in batches:
            made = [(q, p, i == 0) for q, a in zip(*(c.to_pylist() for c in b.columns)) for i, p in enumerate(pieces(a))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made) if made else [[]] * 3, (pa.string(), pa.string(), pa.bool_()))], names=["question", "piece", "begins"])

    usable = table.select("question", "answer").where(F.col("question").isNotNull() & (F.length("answer") > 0))
    parts = usable.mapInArrow(cut, "question string, piece string, begins boolean")
    hashes = parts.select(F.xxhash64("question", "piece", "begins").alias("h"), F.xxhash64("begins", "piece", "question").alias("g")).distinct()
    told = hashes.agg(F.count("*"), F.bit_xor("h"), F.bit_xor("g"), F.sum(F.pmod("h", F.lit(1 << 31))), F.sum(F.pmod("g", F.lit(1 << 31)))).first()
    key = hashlib.sha256(repr((tuple(told), BUCKET_ROWS, PIECE, VERSION, CUES, EXAMPLES, OTHER_LANGUAGES, STOP_WORDS)).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    kept = Versions(spark, f"{shared_root(spark)}/textquarry-models/pairs-{key}")
    if kept.current():
        return pickle.loads(bytes(spark.read.parquet(kept.folder(1)).first()[0]))
    model = _fit_table(spark, parts, max(1, told[0] // BUCKET_ROWS)) if told[0] else fit([])
    model._words.clear()
    model._asked.clear()
    stage = kept.stage()
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.parquet(stage)
    try:
        kept.publish(stage, 0)
    except AlreadyPublished:  # the same model, by another run
        pass
    return model


def defective_pairs(answers: DataFrame) -> DataFrame:
    """``(question_id, defect)``: one row for each defective pair.

    Defects: empty, truncated, refusal, copy, language. A response is cut into
    clauses, a conditional random field tags each as answer, refusal, echo,
    foreign or unfinished, and what the tags cover decides. Repeated rows count
    once. A null question has no language and no words, so only empty,
    truncated and refusal are found; a null ``question_id`` is kept. Words and
    letter groups are counted in all rows, and fields are trained, in buckets,
    on pairs made from all rows and from fixed examples; their mean is kept for
    the next call with these rows. It then tags every row. Whole texts are
    read, by both.
    """
    rows = answers.select("question_id", "question", "answer")
    # some thousand weights, and the words that tell languages
    held = answers.sparkSession.sparkContext.broadcast(stored_model(answers.sparkSession, rows))

    def run(batches):
        defects = held.value.defects
        for b in batches:
            ids, questions, texts = (c.to_pylist() for c in b.columns)
            ids_found, found = [], []
            for at in range(0, len(ids), BATCH):
                own = slice(at, at + BATCH)
                for i, d in zip(ids[own], defects(list(zip(questions[own], texts[own])))):
                    if d:
                        ids_found.append(i)
                        found.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids_found, pa.string()), pa.array(found, pa.string())], names=["question_id", "defect"])

    return rows.mapInArrow(run, "question_id string, defect string").distinct()
