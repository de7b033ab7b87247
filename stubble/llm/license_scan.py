"""License scan: ordered signature rules behind a keyword prefilter.

A text is read as its words: A-Z lower-cased, letters, digits and all characters beyond
ASCII. Every rule is a regular expression over the words joined by blanks, with words that
any match holds. A text first looks up which of these keywords it holds; only rules whose
keywords are all there run. Of overlapping detections the one of higher priority stands;
what lies within the interval of a standing detection is suppressed. Priorities go from a
named identifier over a full name with a version to a name alone.

The rules are built by families (licence x version x wording) from the lists below.

Defined cases: null and empty texts have no words and no detections; a rule matches as often
as it occurs; equal detections of one rule at one place count once; repeated rows give the
same; extra columns of the input stay, but for those with the name of a result, which
are replaced.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stubble.llm import bpe
from stubble.llm.common import with_fields

#: The phrases every scan reports, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs over words joined by blanks; ``keywords`` are words of any match."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float


def _rule(label: str, pattern: str, keywords: str, priority: int, weight: float = 0.9) -> Rule:
    return Rule(label, rf"(?<![^ ]){pattern}(?![^ ])", tuple(keywords.split()), priority, weight)


def _version(v: str) -> str:
    """``2.0`` as words; a trailing zero may be missing."""
    head, _, tail = v.partition(".")
    return rf"{head}(?: {tail})?" if tail == "0" else rf"{head} {tail}" if tail else head


def _spellings(short: str, v: str) -> Iterator[tuple[str, str]]:
    """Patterns of a short name with a version, and the words any match holds: ``gpl v3``, ``gpl3``, ``gplv3``."""
    head = v.partition(".")[0]
    yield rf"{short} (?:version |v ?)?{_version(v)}", short
    yield rf"{short}{_version(v)}", f"{short}{head}"
    yield rf"{short}v{_version(v)}", f"{short}v{head}"
    yield rf"{short}v {_version(v)}", f"{short}v"
    yield rf"{short}version {_version(v)}", f"{short}version"


_LICENSE = r"(?:licen[sc]e|licen[sc]ed|lic)"
_CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}


def _creative_commons() -> Iterator[Rule]:
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        parts = kind.split("-")
        short = "cc " + " ".join(parts)
        full = "creative commons " + " ".join(_CC_PARTS[p] for p in parts)
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            label = f"cc-{kind}-{v}"
            yield _rule(label, rf"{short} {_version(v)}", "cc by", 70 + len(parts))
            yield _rule(label, rf"{full} (?:(?:\S+ ){{0,2}})?{_version(v)}", "creative commons", 80 + len(parts))
            yield _rule(label, rf"spdx license identifier {short} {_version(v)}", "spdx cc by", 95)
        yield _rule(f"cc-{kind}", short, "cc by", 50 + len(parts), 0.7)
        yield _rule(f"cc-{kind}", full, "creative commons", 55 + len(parts), 0.7)
    yield _rule("cc0-1.0", r"cc0(?: 1(?: 0)?)?(?: universal)?", "cc0", 70)
    yield _rule("cc0-1.0", r"creative commons (?:zero|public domain dedication)", "creative commons", 75)
    yield _rule("cc", r"creative commons", "creative commons", 20, 0.4)


def _gnu() -> Iterator[Rule]:
    names = {
        "gpl": ("", ("1.0", "2.0", "3.0")),
        "lgpl": ("(?:lesser|library) ", ("2.0", "2.1", "3.0")),
        "agpl": ("affero ", ("1.0", "3.0")),
    }
    for short, (adjective, versions) in names.items():
        full = rf"(?:gnu )?{adjective}general public license"
        for v in versions:
            number = _version(v)
            for ending, words in (("-or-later", r"(?: or (?:\S+ ){0,3}later(?: version)?| plus)"), ("", "")):
                label = f"{short}-{v}{ending}"
                more = 2 if ending else 0
                yield _rule(label, rf"{full} (?:\S+ )?(?:version |v)?{number}{words}", "general public license", 82 + more)
                yield _rule(label, rf"version {number} of the {full}{words}", "general public license version", 83 + more)
                for pattern, keys in _spellings(short, v):
                    yield _rule(label, rf"(?:gnu )?{pattern}{words}", keys, 70 + more)
                yield _rule(label, rf"{short}v{number}{words}", f"{short}v{v[0]}", 71 + more)
                tag = " or later" if ending else "(?: only)?"
                yield _rule(label, rf"spdx license identifier {short} {number}{tag}", f"spdx {short}", 95 + more)
        yield _rule(short, full, "general public license", 50 + len(adjective), 0.7)
        yield _rule(short, rf"(?:gnu )?{short}", short, 40, 0.6)
    for v in ("1.1", "1.2", "1.3"):
        yield _rule(f"gfdl-{v}", rf"(?:gnu )?free documentation license (?:version )?{_version(v)}", "free documentation license", 80)
    yield _rule("gfdl", r"(?:gnu )?free documentation license", "free documentation license", 50, 0.7)


def _versioned() -> Iterator[Rule]:
    families = {
        "apache": ("apache(?: software)?", "apache", ("1.0", "1.1", "2.0")),
        "mpl": ("mozilla public", "mozilla public", ("1.0", "1.1", "2.0")),
        "epl": ("eclipse public", "eclipse public", ("1.0", "2.0")),
        "eupl": ("european union public", "european union public", ("1.0", "1.1", "1.2")),
        "cddl": ("common development and distribution", "common development distribution", ("1.0", "1.1")),
        "cpl": ("common public", "common public", ("1.0",)),
        "artistic": ("artistic", "artistic", ("1.0", "2.0")),
        "osl": ("open software", "open software", ("1.0", "2.0", "2.1", "3.0")),
        "afl": ("academic free", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        "ofl": ("sil open font", "sil open font", ("1.0", "1.1")),
        "bsl": ("boost software", "boost software", ("1.0",)),
        "php": ("php", "php", ("3.0", "3.1")),
        "psf": ("python software foundation", "python software foundation", ("2.0",)),
        "ecl": ("educational community", "educational community", ("1.0", "2.0")),
        "lppl": ("latex project public", "latex project public", ("1.0", "1.1", "1.2", "1.3")),
        "odbl": ("open (?:data commons open )?database", "open database", ("1.0",)),
    }
    for short, (name, keys, versions) in families.items():
        for v in versions:
            label = f"{short}-{v}"
            yield _rule(label, rf"{name} {_LICENSE} (?:\S+ )?(?:version |v ?)?{_version(v)}", keys, 80)
            for pattern, held in _spellings(short, v):
                yield _rule(label, pattern, held, 65)
            yield _rule(label, rf"spdx license identifier {short} {_version(v)}", f"spdx {short}", 95)
        yield _rule(short, rf"{name} {_LICENSE}", keys, 50, 0.7)


def _single() -> Iterator[Rule]:
    for n, names in {"0": "zero", "1": "one", "2": "two|simplified", "3": "three|new|revised|modified", "4": "four|original|old"}.items():
        label = f"bsd-{n}-clause"
        yield _rule(label, rf"(?:{n}|{names}) (?:clause )?bsd(?: {_LICENSE})?", "bsd", 75)
        yield _rule(label, rf"bsd {n} clause(?: {_LICENSE})?", "bsd clause", 75)
        yield _rule(label, rf"spdx license identifier bsd {n} clause", "spdx bsd", 95)
    yield _rule("bsd", rf"bsd(?: style)? {_LICENSE}", "bsd", 50, 0.7)
    # Label: (pattern of the name, words it holds), one per wording.
    short = {
        "mit": (("mit", "mit"), ("expat", "expat"), ("x11", "x11")),
        "isc": (("isc", "isc"),),
        "zlib": (("zlib(?: libpng)?", "zlib"),),
        "wtfpl": (("wtfpl", "wtfpl"),),
        "ms-pl": (("microsoft public", "microsoft public"),),
        "ms-rl": (("microsoft reciprocal", "microsoft reciprocal"),),
        "ncsa": (("(?:university of illinois )?ncsa(?: open source)?", "ncsa"),),
        "openssl": (("openssl", "openssl"),),
        "ruby": (("ruby", "ruby"),),
        "vim": (("vim", "vim"),),
        "json": (("json", "json"),),
        "postgresql": (("postgresql", "postgresql"),),
        "unicode": (("unicode", "unicode"),),
        "w3c": (("w3c(?: software)?", "w3c"),),
        "curl": (("curl", "curl"),),
        "beerware": (("beerware", "beerware"), ("beer ware", "beer ware")),
        "sleepycat": (("sleepycat", "sleepycat"),),
        "qpl": (("q public", "q public"),),
        "intel": (("intel open source", "intel source"),),
        "ibm": (("ibm public", "ibm public"),),
        "sun": (("sun public", "sun public"),),
        "nokia": (("nokia open source", "nokia source"),),
        "apple": (("apple public source", "apple source"),),
        "real": (("realnetworks public source", "realnetworks"),),
        "zope": (("zope public", "zope public"),),
    }
    for label, names in short.items():
        for name, keys in names:
            yield _rule(label, rf"(?:the )?{name} {_LICENSE}", keys, 60)
            yield _rule(label, rf"{_LICENSE} under (?:the )?{name}", f"under {keys}", 58)
        yield _rule(label, rf"spdx license identifier {label.replace('-', ' ')}", "spdx", 95)
    texts = {
        "mit": r"permission is hereby granted free of charge to any person obtaining a copy",
        "isc": r"permission to use copy modify and or distribute this software for any purpose with or without fee",
        "bsd": r"redistribution and use in source and binary forms with or without modification are permitted",
        "zlib": r"this software is provided as is without any express or implied warranty in no event",
        "unlicense": r"this is free and unencumbered software released into the public domain",
        "apache-2.0": r"you may not use this file except in compliance with the license",
        "bsl-1.0": r"permission is hereby granted free of charge to any person or organization obtaining a copy",
        "gpl": r"this program is free software you can redistribute it and or modify it under the terms",
    }
    for label, text in texts.items():
        yield _rule(label, text, " ".join(sorted(set(text.split()), key=len)[-2:]), 85, 1.0)
    plain = {
        "unlicense": (r"(?:the )?unlicense", "unlicense", 60, 0.9),
        "public-domain": (r"(?:released |dedicated |placed )?(?:into |to |in )?(?:the )?public domain", "public domain", 45, 0.7),
        "copyright": (r"copyright (?:c )?\d{4}(?: \d{4})*", "copyright", 30, 0.5),
        "reserved": (r"all rights reserved", "all rights reserved", 40, 0.9),
        "proprietary": (r"(?:proprietary and confidential|confidential and proprietary)", "proprietary confidential", 45, 0.8),
        "no-warranty": (r"without warranty of any kind", "without warranty", 15, 0.4),
        "commercial-use": (r"not for commercial use", "not commercial use", 25, 0.5),
        "noncommercial": (r"for noncommercial (?:use|purposes)(?: only)?", "noncommercial", 25, 0.5),
        "non-commercial": (r"for non commercial (?:use|purposes)(?: only)?", "non commercial", 25, 0.5),
        "permission": (r"(?:used|reprinted|reproduced) (?:with|by) permission", "permission", 25, 0.5),
        "terms": (r"subject to (?:the )?terms (?:and conditions|of use)", "subject terms", 10, 0.3),
    }
    for label, (pattern, keys, priority, weight) in plain.items():
        yield _rule(label, pattern, keys, priority, weight)


@functools.lru_cache(maxsize=1)
def default_rules() -> tuple[Rule, ...]:
    rules = [*_creative_commons(), *_gnu(), *_versioned(), *_single()]
    return tuple(sorted(rules, key=lambda r: (-r.priority, r.label, r.pattern)))


_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TABLE).split()


def _every(joined: bytes, phrase: bytes) -> list[int]:
    """Places at which the phrase starts; ``joined`` has a blank around each word."""
    found, at = [], joined.find(phrase)
    while at >= 0:
        found.append(at)
        at = joined.find(phrase, at + 1)
    return found


def _blanks_before(codes: np.ndarray, places: list[int]) -> list[int]:
    """How many blanks lie before each place."""
    return np.searchsorted(np.flatnonzero(codes == 32), places).tolist()


class Covered:
    """Spans, and whether one of them holds another one.

    Kept are the spans that no other one holds: their starts and their ends both ascend, so
    the last one that starts early enough reaches furthest.
    """

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.starts, start)
        return at > 0 and self.ends[at - 1] >= end

    def add(self, start: int, end: int) -> None:
        """Add a span that none of them holds."""
        low = bisect.bisect_left(self.starts, start)
        high = max(low, bisect.bisect_right(self.ends, end))
        self.starts[low:high] = [start]
        self.ends[low:high] = [end]


class Scanner:
    """Compiled rules, each filed under the longest of its keywords."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.filed: dict[bytes, list[tuple[Rule, re.Pattern, frozenset[bytes]]]] = {}
        self.always: list[tuple[Rule, re.Pattern, frozenset[bytes]]] = []
        for rule in rules:
            keys = frozenset(k.encode() for k in rule.keywords)
            entry = (rule, re.compile(rule.pattern), keys)
            if keys:
                self.filed.setdefault(max(keys, key=lambda k: (len(k), k)), []).append(entry)
            else:
                self.always.append(entry)
        self.base = [(b" " + p.encode() + b" ", label) for p, label in BASE]
        self.gates = frozenset([*self.filed, *(p.split()[0].encode() for p, _ in BASE)])

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Number of words, base places (label, word) and standing detections (label, first, last, weight)."""
        words = words_of(text)
        held = self.gates.intersection(words)
        if not held and not self.always:
            return len(words), [], []
        there = set(words)
        rules = [e for k in held for e in self.filed.get(k, ()) if e[2] <= there] + self.always
        joined = b" " + b" ".join(words) + b" "
        codes = np.frombuffer(joined, np.uint8)
        base = [
            (label, word) for phrase, label in self.base for word in _blanks_before(codes, _every(joined, phrase))
        ]
        # Undecodable bytes cannot occur in a text column; surrogates keep lengths safe.
        body = joined.decode("utf-8", "surrogateescape")
        found: list[tuple[int, int, Rule]] = []
        for rule, pattern, _ in rules:
            found.extend((m.start(), m.end(), rule) for m in pattern.finditer(body))
        standing: list[tuple[int, int, Rule]] = []
        covered = Covered()
        for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
            if not covered.holds(start, end):
                covered.add(start, end)
                standing.append((start, end, rule))
        standing.sort(key=lambda d: (d[0], d[1], d[2].label))
        letters = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4")
        first = _blanks_before(letters, [a for a, _, _ in standing])
        last = _blanks_before(letters, [b for _, b, _ in standing])
        spans = [(r.label, a - 1, b - 1, r.weight) for (_, _, r), a, b in zip(standing, first, last)]
        return len(words), base, spans


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


DETECTIONS = "array<struct<label:string,first_word:long,last_word:long,weight:double>>"
PLACES = "array<struct<label:string,word:long>>"


def scan_licenses(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows without their text, with n_words, ``places`` of base phrases and ``detections``."""
    kept, schema = with_fields(df, text, f"n_words long, places {PLACES}, detections {DETECTIONS}")
    names = schema.names
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span = pa.list_(
        pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("weight", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules or default_rules()).scan
        for batch in batches:
            for part, texts in bpe.blocks(batch, text):
                found = [scan(t) for t in texts]
                columns = [
                    *map(part.column, kept),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"label": a, "word": w} for a, w in f[1]] for f in found], place),
                    pa.array(
                        [[{"label": a, "first_word": s, "last_word": e, "weight": w} for a, s, e, w in f[2]] for f in found],
                        span,
                    ),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)
