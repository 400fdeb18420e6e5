"""License scans: Aho-Corasick over the words of each text, a shunting-yard parser for SPDX expressions.

A text becomes its words joined by single spaces (bytes, A-Z lower-cased), so one automaton finds every phrase
whose words stand consecutively, whatever stands between them. Where it finds the tag
`SPDX-License-Identifier`, the rest of that line is parsed as an expression of identifiers, `and`, `or`, `with`
and parentheses; its value is the most permissive of `or`, the most restrictive of `and`.

labels: the base labels, `notice:` labels of the other phrases, `spdx:` labels of the identifiers in expressions,
and `terms:` the value of each expression. score: 1 - 0.5**k over the k places and expressions found.

Cases: a null text is empty. A tag whose line has no expression, or a malformed one (an operator without its operand, a
parenthesis left open, `with` without a known exception), gives `terms:unparsed`; a licence that isn't known
by exactly its identifier gives `terms:unknown`. A document that is
repeated is reported each time. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from octolith.llm.common import text_slices, texts_only
from octolith.llm.words import ALNUM

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own phrases, from names of licences and the words that licence texts begin with.
NOTICES = {
    "mit license": "notice:mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "notice:mit",
    "apache license": "notice:apache",
    "licensed under the apache license version 2 0": "notice:apache-2.0",
    "bsd license": "notice:bsd",
    "redistribution and use in source and binary forms": "notice:bsd",
    "neither the name of": "notice:bsd-3-clause",
    "isc license": "notice:isc",
    "permission to use copy modify and or distribute this software for any purpose": "notice:isc",
    "zlib license": "notice:zlib",
    "boost software license": "notice:boost",
    "mozilla public license": "notice:mpl",
    "eclipse public license": "notice:epl",
    "common development and distribution license": "notice:cddl",
    "european union public licence": "notice:eupl",
    "artistic license": "notice:artistic",
    "python software foundation license": "notice:psf",
    "gnu general public license": "notice:gnu-gpl",
    "this program is free software you can redistribute it and or modify": "notice:gnu-gpl",
    "either version 2 of the license or at your option any later version": "notice:or-later",
    "either version 3 of the license or at your option any later version": "notice:or-later",
    "lesser general public license": "notice:lgpl",
    "library general public license": "notice:lgpl",
    "affero general public license": "notice:agpl",
    "free documentation license": "notice:gfdl",
    "server side public license": "notice:sspl",
    "business source license": "notice:busl",
    "open database license": "notice:odbl",
    "sil open font license": "notice:ofl",
    "creative commons": "notice:creative-commons",
    "cc by nc": "notice:cc-by-nc",
    "cc by sa": "notice:cc-by-sa",
    "cc by nd": "notice:cc-by-nd",
    "attribution sharealike": "notice:cc-by-sa",
    "attribution noncommercial": "notice:cc-by-nc",
    "cc0 1 0 universal": "notice:cc0",
    "to the extent possible under law": "notice:cc0",
    "free and unencumbered software released into the public domain": "notice:unlicense",
    "public domain": "notice:public-domain",
    "licensed under": "notice:licensed-under",
    "released under": "notice:released-under",
    "some rights reserved": "notice:some-rights",
    "no rights reserved": "notice:no-rights",
    "the software is provided as is": "notice:as-is",
    "without warranty of any kind": "notice:no-warranty",
    "for non commercial use only": "notice:noncommercial",
    "do not redistribute": "notice:no-redistribution",
    "proprietary and confidential": "notice:proprietary",
}
TAG = "spdx license identifier"
#: Identifiers by how much a licence asks for: nothing but credit, changes to its files, the whole work, more.
IDENTIFIERS = [
    """0BSD AFL-2.1 AFL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent
    BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSD-Source-Code BSL-1.0 BlueOak-1.0.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0
    CC-BY-4.0 CC0-1.0 FSFAP FTL HPND ICU IJG ISC JSON Libpng MIT MIT-0 MIT-CMU MIT-feh MS-PL MulanPSL-2.0 NCSA NTP ODC-By-1.0
    OFL-1.1 OLDAP-2.8 OpenSSL PDDL-1.0 PHP-3.0 PHP-3.01 PSF-2.0 PostgreSQL Python-2.0 Ruby TCL UPL-1.0 Unicode-3.0
    Unicode-DFS-2016 Unlicense Vim W3C WTFPL X11 Zlib ZPL-2.0 ZPL-2.1 bzip2-1.0.6 curl libpng-2.0 libtiff zlib-acknowledgement""",
    """APSL-2.0 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CPL-1.0 EPL-1.0 EPL-2.0
    IPL-1.0 LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only
    LGPL-3.0-or-later MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-RL ODbL-1.0""",
    """CECILL-2.0 CECILL-2.1 EUPL-1.0 EUPL-1.1 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0
    GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later OSL-2.1 OSL-3.0 QPL-1.0 Sleepycat""",
    """AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later BUSL-1.1 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0
    CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 Elastic-2.0 SSPL-1.0""",
]
#: What may stand after `with`.
EXCEPTIONS = """Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0
    Font-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 LLVM-exception Libtool-exception Linux-syscall-note
    OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Swift-exception
    Universal-FOSS-exception-1.0 WxWindows-exception-3.1 eCos-exception-2.0 u-boot-exception-2.0"""
_LEVEL = {x.lower(): level for level, names in enumerate(IDENTIFIERS) for x in names.split()}
_EXCEPTION = set(EXCEPTIONS.lower().split())
TERMS = ["permissive", "weak-copyleft", "copyleft", "restricted", "unknown"]
OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_TABLE = bytes(b or 32 for b in ALNUM.tolist())
_LINE = re.compile(rb"spdx-license-identifier[^a-z0-9\r\n(]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in {**BASE, **NOTICES, TAG: TAG}.items():
        a.add_word(f" {phrase} ", (label, phrase in BASE, len(phrase) + 2))
    a.make_automaton()
    return a


def family(identifier: str) -> int:
    """What a licence asks for, by its exact identifier, `+` for later versions aside; 4 if unknown."""
    return _LEVEL.get(identifier.removesuffix("+"), 4)


def postfix(text: str) -> list[str]:
    """The expression that `text` begins with, in postfix order; empty if it begins with none or it is malformed.

    It ends before a word where an operator or a closing parenthesis would have to stand, or before any other character.
    """
    out: list[str] = []
    ops: list[str] = []
    want, at = True, 0  # want: an operand or an opening parenthesis comes next
    while m := _TOKEN.match(text, at):
        token = m[1].lower().rstrip(".:")
        if want:
            if token == "(":
                ops.append(token)
            elif token == ")" or token in _BINDS or bool(ops and ops[-1] == "with") != (token in _EXCEPTION):
                return []
            else:
                out.append(token)
                want = False
        elif token == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        elif token in _BINDS:
            if token == "with" and (out[-1] in _BINDS or out[-1] in _EXCEPTION):
                return []  # an exception goes with a licence
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[token]:
                out.append(ops.pop())
            ops.append(token)
            want = True
        else:
            break
        at = m.end()
    return [] if want or "(" in ops else out + ops[::-1]


def evaluate(post: list[str]) -> str:
    """The terms of a postfix expression: the least of `or`, the most of `and`; an exception frees copyleft by a step."""
    stack: list[int] = []
    for token in post:
        if token in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if token == "or" else max(a, b) if token == "and" else a if a in (0, 3, 4) else a - 1)
        else:
            stack.append(family(token))
    return TERMS[stack[0]]


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = text.translate(_TABLE).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    base: set[str] = set()
    labels: set[str] = set()
    n_base = places = 0
    first = last = None
    at = count = 0
    for end, (label, is_base, size) in automaton().iter(line):
        if label == TAG:
            labels.add("notice:spdx")
            continue
        labels.add(label)
        places += 1
        if is_base:
            base.add(label)
            n_base += 1
            start = end - size + 1
            count += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            first = count if first is None else min(first, count)
            last = count if last is None else max(last, count)
    if "notice:spdx" in labels:
        for m in _LINE.finditer(text):
            post = postfix(m[1].decode("utf-8", "replace"))
            labels |= {f"spdx:{x}" for x in post if x not in _BINDS and x not in _EXCEPTION}
            labels.add(f"terms:{evaluate(post)}" if post else "terms:unparsed")
            places += 1
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - 0.5**places


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, texts in text_slices(b):
                cols = list(zip(*(scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in OUT.split(", ")])

    return texts_only(docs).mapInArrow(run, OUT)
