"""Secrets in texts, by lexing assignments: name-literal pairs, constants and sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import id_and_text, in_batches

ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
SHORTEST_VALUE = 6

# Sensitivity of the words that a target's name is made of.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8,
    "private": 0.4, "access": 0.3, "api": 0.3, "key": 0.5, "signing": 0.4, "encryption": 0.4, "client": 0.1,
}
THRESHOLD = 0.6
SIGN = re.compile(r"[:=]")
NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]{0,79}"
# The name before a sign, blanks left out: closing quote or index, array bounds, the colon of := .
NAME_BEFORE = re.compile(rf"({NAME})(?:[\"'\]]{{1,2}}|\[\d*\])?\s*:?$")
NAME_ROOM = 120
# name: type, or var name type, before the sign of an assignment.
LINE_ROOM = 400
ARGUMENTS = r"[<\[](?:[^<>\[\]\n=]|[<\[][^<>\[\]\n=]*[>\]]){0,120}[>\]]"
ATOM = rf"[&*]*(?:'[a-z_]+[\x20\t]+)?(?:(?:mut|dyn|const|readonly)[\x20\t]+)?[A-Za-z_$][A-Za-z0-9_$.:]*(?:{ARGUMENTS})?(?:\[\])*[?!]?"
TYPE = rf"{ATOM}(?:[\x20\t]*\|[\x20\t]*{ATOM})*"
ANNOTATED = re.compile(rf"(?<![A-Za-z0-9_$.-])({NAME})[?!]?[\x20\t]*:[\x20\t]*{TYPE}$")
DECLARED = re.compile(rf"\b(?:var|const)[\x20\t]+({NAME})[\x20\t]+{TYPE}$")
PREFIX = r"(?:[rR][bB]|[bBfF][rR]|u8|[bBrRuUfFL]|[$@]{1,2})"
STRING = (
    rf"{PREFIX}?(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\")){{0,4000}}\"\"\"|'{{3}}(?:[^'\\]|\\.|'(?!'')){{0,4000}}'{{3}}"
    r"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)|b?r#{1,4}\"[^\"\n]*\"#{1,4}"
)
TERM = rf"(?:{STRING}|[A-Za-z_$][A-Za-z0-9_$.]*)"
VALUE = re.compile(rf"[=>]?[\x20\t]*({TERM}(?:[\x20\t]*\+[\x20\t]*{TERM})*)")
TERMS = re.compile(TERM)
OPENING = re.compile(r"([A-Za-z0-9$@]*)(#*)(\"{3}|'{3}|[\"'`])")
SLOTS = re.compile(r"\$?\{[^{}]*\}")
# A line of configuration: name, sign, value without quotes to the end of the line or to a comment.
LINE_HEAD = re.compile(r"[\x20\t]*(?:-[\x20\t]+)?(export[\x20\t]+|set[\x20\t]+|ENV[\x20\t]+)?")
BARE = re.compile(r"[\x20\t]*([^\s\"'`=>][^\s]*)[\x20\t]*(?:[\x20\t][#;][^\n]*)?\r?(?=\n|\Z)")
NOT_BARE = re.compile(r"\$[A-Za-z_{(]|[<%{(\[&*|>]|[A-Za-z_$][\w.$:>-]*[(\[{]|.*[;,{(]$")
PLAIN_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*")
ENV_NAME = re.compile(r"[A-Z][A-Z0-9_]*")
SHORTEST_PLAIN = 8
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Finding(NamedTuple):
    start: int
    kind: int
    end: int
    value_start: int
    value_end: int


def name_score(name: str) -> float:
    """Sum of the weights of the name's words, at most 1."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    return min(1.0, sum(NAME_WEIGHTS.get(w, 0.0) for w in set(words)))


def literal_score(value: str) -> float:
    """How much a literal looks like key material: length, mixed characters, entropy; 0 to 1."""
    if len(value) < SHORTEST_VALUE or any(c.isspace() for c in value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit)) + (not value.isalnum())
    return min(1.0, entropy / 3.5) * min(1.0, (1 + kinds) / 3)


def base_findings(text: str) -> list[Finding]:
    found = [
        Finding(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST_VALUE
    ]
    found += [Finding(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text)]
    found += [Finding(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found)


def target_names(text: str, at: int) -> tuple[list[str], int] | None:
    """Names that the sign at ``at`` assigns to, and where the one next to it starts."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    if end and text[end - 1] == ":":
        end -= 1
        while end and text[end - 1].isspace():
            end -= 1
    near = NAME_BEFORE.search(text[max(0, end - NAME_ROOM) : end])
    names = [near.group(1)] if near else []
    if text[at] == "=":
        line = text[max(0, end - LINE_ROOM, text.rfind("\n", max(0, end - LINE_ROOM), end) + 1) : end]
        if ":" in line or "var" in line or "const" in line:
            typed = ANNOTATED.search(line) or DECLARED.search(line)
            names += [typed.group(1)] if typed else []
    return (names, max(0, end - NAME_ROOM) + near.start(1) if near else -1) if names else None


def bare_value(text: str, sign: int, name: str, name_start: int) -> tuple[int, int] | None:
    """Where the unquoted value of a configuration line lies; None in other lines.

    An unquoted word may be a name of the program. After an upper-case name and a sign without
    blanks it is a value; elsewhere only if it has a digit and eight characters, or a
    character that names do not have.
    """
    floor = max(0, name_start - LINE_ROOM)
    line = text.rfind("\n", floor, name_start) + 1
    head = LINE_HEAD.fullmatch(text, line, name_start) if line or not floor else None
    value = head and BARE.match(text, sign + 1)
    if not value or NOT_BARE.match(value.group(1)):
        return None
    word = PLAIN_NAME.fullmatch(value.group(1))
    shell = text[sign] == "=" and value.start(1) == sign + 1 and (head.group(1) or ENV_NAME.fullmatch(name))
    if word and not shell:
        told = any(c.isdigit() for c in word.group()) and len(word.group()) >= SHORTEST_PLAIN
        if word.group(1) or not told:
            return None
    return value.span(1)


def quoted(text: str, start: int, end: int) -> tuple[int, int, bool] | None:
    """Content of the quoted term there, and whether it has slots to fill; None for a name."""
    opening = OPENING.match(text, start, end)
    if not opening:
        return None
    prefix, marks, quote = opening.groups()
    slots = quote == "`" or "f" in prefix.lower() or "$" in prefix
    return opening.end(), end - len(quote) - len(marks), slots


def lexed_findings(text: str, base: list[Finding] = []) -> list[Finding]:
    """Literals that reach a target with a sensitive name, directly or through constants.

    One without blanks in which a value of ``base`` assignments starts is taken at any score.
    """
    constants: dict[str, list[tuple[int, int, bool]]] = {}
    found: dict[tuple[int, int], None] = {}
    begun = {x.value_start for x in base if x.kind == 0}
    for sign in SIGN.finditer(text):
        target = target_names(text, sign.start())
        if not target:
            continue
        names, name_start = target
        literals: list[tuple[int, int, bool]] = []
        value = VALUE.match(text, sign.end())
        text_first = value and quoted(text, *TERMS.match(text, value.start(1)).span())
        bare = bare_value(text, sign.start(), names[0], name_start) if name_start >= 0 and not text_first else None
        if bare and text[bare[0] : bare[1]] not in constants:
            literals = [(*bare, False)]
        elif value:
            for term in TERMS.finditer(text, value.start(1), value.end(1)):
                content = quoted(text, *term.span())
                literals += [content] if content else constants.get(term.group(), [])
        else:
            continue
        # A name keeps the literals of its last assignment.
        literals = list(dict.fromkeys(literals))
        constants.update(dict.fromkeys(names, literals))
        whole = "".join(SLOTS.sub("", text[a:b]) if slots else text[a:b] for a, b, slots in literals)
        if literals and max(map(name_score, names)) * literal_score(whole) >= THRESHOLD:
            found.update(dict.fromkeys((a, b) for a, b, _ in literals))
        found.update(dict.fromkeys((a, b) for a, b, _ in literals if a in begun and not any(c.isspace() for c in text[a:b])))
    return [Finding(a, 3, b, a, b) for a, b in sorted(found)]


def findings(text: str) -> list[Finding]:
    """Base findings, and lexed literals that no base value contains; by start, then kind."""
    base = base_findings(text)
    lexed = [
        x for x in lexed_findings(text, base)
        if not any(b.value_start <= x.value_start and x.value_end <= b.value_end for b in base)
    ]
    return sorted(base + lexed)


def joined(found: list[Finding]) -> str:
    return ",".join(f"{KINDS[x.kind]}:{x.start}:{x.end}" for x in found)


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """``text`` with every found value replaced; overlapping values share one mark."""
    parts, done = [], 0
    for start, end in sorted((x.value_start, x.value_end) for x in findings(text)):
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, end)
    return "".join(parts) + text[done:]


def secret_spans(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind. A null
    or empty text has no spans. Repeated rows are scanned each; a null id stays null; an
    empty table gives no rows; other columns are not read.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = findings(text)
                kinds = Counter(x.kind for x in found)
                base = joined([x for x in found if x.kind < 3])
                rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(base.encode()).hexdigest(), joined(found), kinds[3]))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"],
            )

    return in_batches(id_and_text(docs, id_column)).mapInArrow(
        scanned,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long",
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the found values masked in ``text``; all rows and columns stay, nulls too."""
    place = docs.columns.index(text)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, text, pa.array(texts, batch.schema.field(place).type))

    out = in_batches(docs).mapInArrow(masked, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in out.columns else out
