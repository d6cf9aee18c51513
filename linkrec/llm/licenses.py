"""Licence tags and notices in texts.

An Aho-Corasick automaton over word-separated text finds notice phrases and licence
tags in one pass.  The expression behind a tag is read from the place where the automaton
found it by a shunting-yard parser with the precedence WITH, AND, OR; its names are checked
against known licences and exceptions, and its postfix form is evaluated against the
licences that are allowed.
"""

from __future__ import annotations

import ahocorasick
import regex
from pyspark.sql import DataFrame

from linkrec.llm.common import arrow_map, texts

# Phrases and labels that always count.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Further notices, phrase and label.
PHRASES = {
    "creative commons": "cc",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software": "unlicense",
    "without warranty of any kind": "no-warranty",
}
# Full names of licences with versions, and the first part of their ids.
NAMES = {
    "academic free license": "afl",
    "apache license": "apache",
    "apache software license": "apache",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "eclipse public license": "epl",
    "educational community license": "ecl",
    "european union public licence": "eupl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "latex project public license": "lppl",
    "mozilla public license": "mpl",
    "open software license": "osl",
    "sil open font license": "ofl",
    "zope public license": "zpl",
}
# Versions by the first part of the id.
VERSIONS = {
    "afl": "1.1 1.2 2.0 2.1 3.0",
    "agpl": "1.0 3.0",
    "apache": "1.0 1.1 2.0",
    "artistic": "1.0 2.0",
    "bsl": "1.0",
    "cc-by": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc-nd": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc-sa": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nd": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-sa": "1.0 2.0 2.5 3.0 4.0",
    "cc0": "1.0",
    "cddl": "1.0 1.1",
    "cpl": "1.0",
    "ecl": "1.0 2.0",
    "epl": "1.0 2.0",
    "eupl": "1.0 1.1 1.2",
    "gfdl": "1.1 1.2 1.3",
    "gpl": "1.0 2.0 3.0",
    "lgpl": "2.0 2.1 3.0",
    "lppl": "1.0 1.1 1.2",
    "mpl": "1.0 1.1 2.0",
    "odbl": "1.0",
    "ofl": "1.0 1.1",
    "osl": "1.0 1.1 2.0 2.1 3.0",
    "pddl": "1.0",
    "php": "3.0 3.01",
    "upl": "1.0",
    "zpl": "1.1 2.0 2.1",
}
# Ids that may end in -only or -or-later.
GNU = ["agpl", "gfdl", "gpl", "lgpl"]
# Ids that follow no such rule.
OTHER_IDS = (
    "0bsd beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause "
    "bsd-3-clause-clear bsd-4-clause curl ftl hpnd icu ijg isc json libpng mit mit-0 ms-pl ms-rl "
    "ncsa openssl postgresql python-2.0 ruby sleepycat tcl unlicense vim w3c wtfpl x11 zlib"
)
# What may stand after WITH.
EXCEPTIONS = frozenset(
    (
        "autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception "
        "classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 "
        "libtool-exception linux-syscall-note llvm-exception ocaml-lgpl-linking-exception "
        "qt-gpl-exception-1.0 swift-exception u-boot-exception-2.0 wxwindows-exception-3.1"
    ).split()
)
TAG = "spdx license identifier"
# Licences that an expression may come down to.
ALLOWED = frozenset(
    ["0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0", "cc0-1.0", "isc", "mit"]
    + ["unlicense", "zlib"]
)
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
# Behind the last word of a tag; ids of one's own making are those that start so.
LINE = regex.compile(r"[ \t]*:[ \t]*([^\r\n]*)")
OWN_ID = regex.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
TOKEN = regex.compile(r"[()]|[^\s()]+")
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def known_ids() -> frozenset[str]:
    """Licence ids in lower case: each family with its versions, and the others."""
    ids = set(OTHER_IDS.split())
    for family, versions in VERSIONS.items():
        for v in versions.split():
            ids.add(f"{family}-{v}")
            if family in GNU:
                ids |= {f"{family}-{v}-only", f"{family}-{v}-or-later"}
    return frozenset(ids)


def notice_phrases() -> dict[str, str]:
    """Phrases and labels: the fixed ones, and full names with and without a version."""
    found = dict(PHRASES)
    for name, family in NAMES.items():
        found[name] = family
        for v in VERSIONS[family].split():
            spelt = {v.replace(".", " "), v.removesuffix(".0")} - {v}
            for number in spelt:
                for between in (" version ", " v", " "):
                    found[f"{name}{between}{number}"] = f"{family}-{v}"
    return found


KNOWN = known_ids()
NOTICES = notice_phrases()


def words(text: str) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, with A-Z in lower case."""
    return text.encode().lower().translate(_WORD).split()


def to_postfix(line: str) -> list[str] | None:
    """The expression that a line starts with, in postfix order; None if there is none.

    Reading stops where the line goes on in a way no expression can, as after a
    finished one in running text.
    """
    out: list[str] = []
    stack: list[str] = []
    want_name = True
    depth = 0
    for token in TOKEN.findall(line):
        operator = token.upper() if token.upper() in PRECEDENCE else None
        if want_name:
            if token == "(":
                stack.append(token)
                depth += 1
                continue
            if operator or token == ")":
                return None
            out.append(token.lower().rstrip(".,;"))
            want_name = False
        elif token == ")":
            if not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif operator:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[operator]:
                out.append(stack.pop())
            stack.append(operator)
            want_name = True
        else:
            break
    if want_name or depth:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str]) -> bool:
    """Whether the licences in ``allowed`` meet the expression.

    A licence WITH an exception is met if the licence or the pair of both is allowed,
    as an exception only adds rights.
    """
    stack: list[tuple[bool, str]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append((token in allowed or token.removesuffix("+") in allowed, token))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "WITH":
            pair = f"{left} with {right}"
            stack.append((a or pair in allowed, pair))
        else:
            stack.append((a and b if token == "AND" else a or b, ""))
    return stack[0][0]


def is_known(
    postfix: list[str], known: frozenset[str] = KNOWN, exceptions: frozenset[str] = EXCEPTIONS
) -> bool:
    """Whether an expression has known licences, own ones, and known exceptions after WITH."""
    kinds: list[str] = []
    for token in postfix:
        if token in PRECEDENCE:
            right, left = kinds.pop(), kinds.pop()
            fits = ("licence", "exception") if token == "WITH" else ("terms", "terms")
            sides = [
                kind == want or (want == "terms" and kind == "licence")
                for kind, want in zip((left, right), fits)
            ]
            if not all(sides):
                return False
            kinds.append("terms")
        elif token.removesuffix("+") in known or OWN_ID.fullmatch(token):
            kinds.append("licence")
        elif token in exceptions:
            kinds.append("exception")
        else:
            return False
    return kinds[0] != "exception"


class Scanner:
    def __init__(
        self,
        base: dict[str, str],
        notices: dict[str, str],
        allowed: frozenset[str],
        known: frozenset[str] = KNOWN,
        exceptions: frozenset[str] = EXCEPTIONS,
    ):
        self.base, self.allowed, self.known, self.exceptions = base, allowed, known, exceptions
        self.phrases = ahocorasick.Automaton()
        for phrase in {*base, *notices, TAG}:
            self.phrases.add_word(f" {phrase} ", phrase)
        self.phrases.make_automaton()
        self.notices = notices

    def _lines(self, text: str, tags: list[int]) -> list[str]:
        """What stands behind the tags that start at these words, to the end of their lines."""
        if not tags:
            return []
        want, lines = iter(tags), []
        nth = next(want)
        start = 0
        for i, word in enumerate(WORD.finditer(text)):
            if i == nth:
                start = word.start()
            elif i == nth + 2:
                # In running text the three words are no tag.
                if text[start : word.end()].lower() == TAG.replace(" ", "-"):
                    behind = LINE.match(text, word.end())
                    if behind:
                        lines.append(behind[1])
                nth = next(want, -3)
        return lines

    def scan(self, text: str) -> dict:
        found = words(text)
        line = f" {b' '.join(found).decode()} "
        base_at: list[int] = []
        base_labels: set[str] = set()
        longest: dict[int, str] = {}
        covered: dict[int, int] = {}
        tags: list[int] = []
        seen = at = 0
        for end, phrase in self.phrases.iter(line):
            start = end - len(phrase) - 1
            # Words before the match, counted on from the last one; matches may step back.
            at += line.count(" ", seen, start) if start >= seen else -line.count(" ", start, seen)
            seen = start
            if phrase == TAG:
                tags.append(at)
                continue
            if phrase in self.base:
                base_at.append(at)
                base_labels.add(self.base[phrase])
                covered[at] = max(covered.get(at, 0), at + phrase.count(" ") + 1)
            if phrase in self.notices:
                # "version 1" is not what "version 1 1" says, be that version known or not.
                after = line[end + 1 : end + 4].split(" ")[0]
                if phrase[-1].isdigit() and after.isdigit() and len(after) < 3:
                    continue
                # The longest of the notices that start here, as ends grow.
                longest[at] = phrase
        labels = base_labels | {self.notices[p] for p in longest.values()}
        for i, phrase in longest.items():
            covered[i] = max(covered.get(i, 0), i + phrase.count(" ") + 1)
        n_covered = reach = 0
        for i, end in sorted(covered.items()):
            n_covered += max(0, end - max(i, reach))
            reach = max(reach, end)
        expressions, malformed, permitted = [], [], None
        for behind in self._lines(text, tags):
            postfix = to_postfix(behind)
            fine = False
            if postfix and is_known(postfix, self.known, self.exceptions):
                expressions.append(" ".join(postfix))
                labels |= {t for t in postfix if t not in PRECEDENCE}
                fine = evaluate(postfix, self.allowed)
            else:
                malformed.append(behind)
            permitted = fine if permitted is None else permitted and fine
        return {
            "n_words": len(found),
            "n_base": len(base_at),
            "first_word": min(base_at, default=None),
            "last_word": max(base_at, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels)),
            "score": 1.0 if expressions else n_covered / (n_covered + 4.0),
            "expressions": expressions,
            "permitted": permitted,
            "malformed": malformed,
        }


def scan_licenses(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    base: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    allowed: frozenset[str] = ALLOWED,
    known: frozenset[str] = KNOWN,
    exceptions: frozenset[str] = EXCEPTIONS,
) -> DataFrame:
    """A row per row of ``df`` with what its whole text says about its licence.

    ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and ``last_word``
    (smallest and largest start of these, null if none), ``base_labels`` and ``labels``
    (distinct, sorted, joined by commas; ``labels`` also has notices, of those that start at
    one word the longest, and the licences of well-formed tags), ``score`` (1 with a
    well-formed tag, else it grows with the words that phrases cover), ``expressions``
    (postfix, in order of place), ``permitted`` (all tags are well formed and met by
    ``allowed``; null without one) and ``malformed`` (the lines behind tags that are no
    expression, or name what is not in ``known`` or, after WITH, in ``exceptions``).
    A null text counts as empty: no words, no labels.  Repeated rows and null keys give a
    row each.  A text is scanned whole, however long, by one task.
    """
    given = texts(df, doc_id, text)
    kind = given.schema[0].dataType.simpleString()
    base = BASE if base is None else base
    notices = NOTICES if notices is None else notices

    def rows(docs):
        own = Scanner(base, notices, allowed, known, exceptions)
        for d in docs:
            yield {"doc_id": d["doc_id"]} | own.scan(d["text"])

    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, expressions array<string>, "
        "permitted boolean, malformed array<string>"
    )
    return arrow_map(given, rows, schema)
