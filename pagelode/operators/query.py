"""The full-text query language: words to a tree, and the tree to a condition on token arrays.

A query is terms joined by AND. A term is a phrase in double quotes, a word, a prefix (``foo*``), a word with hyphens
(a phrase or one word), a word with an apostrophe (a phrase), or a raw expression with brackets, ``^``, a column name, AND,
OR and NOT. Malformed queries either give a message or, for unknown columns, no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules, text

SYNTAX = "Search syntax error: check quotes or special characters."
DATABASE = "Database error."
COLUMNS = {"text"}
_TERMS = re.compile(r'"[^"]+"|[^\s+]+')
_KEYWORDS = {"and", "or", "not", "near"}
_FOLD = str.maketrans(rules.ACCENTED, rules.PLAIN)


class QueryError(ValueError):
    """A query that can't be read; the message is what users see."""


class UnknownColumn(QueryError):
    """A condition on a column that isn't there: the result is empty, without a message."""


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens; the last one may be a prefix, and the first may have to be the first of the text. No tokens: never true."""

    tokens: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    keep: object
    drop: object


@dataclass
class Query:
    tree: object | None
    terms: list[str] = field(default_factory=list)  # for highlighting
    error: str | None = None

    @property
    def empty(self) -> bool:
        return self.tree is None


def fold_token(s: str) -> list[str]:
    """Tokens of a string as the index has them."""
    lowered = s.lower().translate(_FOLD)
    out, word = [], []
    for c in lowered:
        if _is_token_char(c):
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out + (["".join(word)] if word else [])


def _is_token_char(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co"


def _all(parts: list) -> object:
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def parse(query: str) -> Query:
    """Never raises: a malformed query has ``error`` set, or an empty tree where it silently matches nothing."""
    text_ = re.sub(r'"+', '"', query.replace("“", '"').replace("”", '"'))
    raw = _TERMS.findall(text_)
    terms = [t.strip('"') for t in raw if t.strip('"')]
    if not terms:
        return Query(None)
    parts: list[object] = []
    try:
        for t in raw:
            if (made := _term(t)) is not None:
                parts.append(made)
        if not parts:
            raise QueryError(SYNTAX)
        return Query(_all(parts), terms)
    except UnknownColumn:
        return Query(Phrase(()), terms)
    except QueryError as e:
        return Query(None, terms, str(e))


def _term(term: str) -> object | None:
    if len(term) > 1 and term[0] == term[-1] == '"':
        inner = term[1:-1]
        if inner.endswith("*") and len(term) > 3:
            return _raw(inner)
        return Phrase(tuple(fold_token(inner)))
    if not term.strip('"'):
        return None
    if term.lower() in _KEYWORDS:
        return Phrase((term.lower(),))
    if term.startswith("*"):
        term = term.lstrip("*")
        if not term:
            return None
    if '"' in term:
        raise QueryError(DATABASE)
    if "-" in term and not term.startswith("-") and not term.endswith("-") and not re.search(r"[():^]", term):
        return Or((Phrase(tuple(fold_token(term.replace("-", " ")))), Phrase(tuple(fold_token(term.replace("-", ""))))))
    if "'" in term or "’" in term:
        return Phrase(tuple(fold_token(term)))
    return _raw(term)


_LEX = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<colon>:)|(?P<star>\*)|(?P<caret>\^)|(?P<minus>-)|"(?P<quoted>(?:[^"]|"")*)"|(?P<word>[\w\x1a\u0080-\U0010ffff]+)|(?P<bad>\S))')


def _raw(source: str) -> object:
    """An expression with its own operators: NOT binds closest, then AND (also where nothing stands), then OR."""
    lexed = [(m.lastgroup, m[m.lastgroup]) for m in _LEX.finditer(source) if m.lastgroup]
    at = 0

    def peek(k: int = 0) -> tuple[str, str]:
        return lexed[at + k] if at + k < len(lexed) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return lexed[at - 1]

    def word_is(name: str) -> bool:
        return peek() == ("word", name)

    def either() -> object:
        parts = [both()]
        while word_is("OR"):
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both() -> object:
        parts = [without()]
        while True:
            if word_is("AND"):
                take()
            elif peek()[0] in ("end", "close") or word_is("OR"):
                return _all(parts)
            parts.append(without())

    def without() -> object:
        made = single()
        while word_is("NOT"):
            take()
            made = Not(made, single())
        return made

    def single() -> object:
        kind, value = peek()
        if kind == "open":
            take()
            made = either()
            if peek()[0] != "close":
                raise QueryError(SYNTAX)
            take()
            return made
        if kind == "minus":
            if peek(1)[0] == "word":
                raise UnknownColumn(SYNTAX)
            raise QueryError(SYNTAX)
        if kind == "word" and peek(1)[0] == "colon":
            if value.lower() not in COLUMNS:
                raise UnknownColumn(SYNTAX)
            take()
            take()
            if peek()[0] == "end":
                raise QueryError(SYNTAX)
            return single()
        initial = kind == "caret"
        if initial:
            take()
            kind, value = peek()
        if kind not in ("word", "quoted") or (kind == "word" and value in ("AND", "OR", "NOT")):
            raise QueryError(SYNTAX)
        take()
        prefix = peek()[0] == "star"
        if prefix:
            take()
        return Phrase(tuple(fold_token(value)), prefix, initial)

    made = either()
    if peek()[0] != "end":
        raise QueryError(SYNTAX)
    return made


def condition(tree: object, tokens: Column) -> Column:
    """Whether a token text (see :func:`..functions.text.token_text`) satisfies the tree: plain substring tests, no lambdas."""
    if isinstance(tree, And):
        return reduce(lambda a, b: a & b, [condition(p, tokens) for p in tree.parts])
    if isinstance(tree, Or):
        return reduce(lambda a, b: a | b, [condition(p, tokens) for p in tree.parts])
    if isinstance(tree, Not):
        return condition(tree.keep, tokens) & ~condition(tree.drop, tokens)
    return _phrase(tree, tokens)


def _phrase(p: Phrase, tokens: Column) -> Column:
    if not p.tokens:
        return F.lit(False)
    wanted = F.lit(" " + " ".join(p.tokens) + ("" if p.prefix else " "))
    return F.startswith(tokens, wanted) if p.initial else F.contains(tokens, wanted)
