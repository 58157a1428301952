"""Language of a piece of code by its first telling line, as a column and as a Python twin."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, tried in this order: pattern (anchors mean lines) and language.
LANGUAGES = (
    (r"^\s*<\?php\b", "php"),
    (r"^\s*#!\s*/usr/bin/env\s+(?:python3?|python)\b", "python"),
    (r"^\s*#!\s*/usr/bin/python", "python"),
    (r"^\s*#!\s*/usr/bin/env\s+(?:node|nodejs)\b", "javascript"),
    (r"^\s*#!\s*/usr/bin/env\s+ruby\b", "ruby"),
    (r"^\s*#!\s*/usr/bin/env\s+perl\b", "perl"),
    (r"^\s*#!\s*/usr/bin/env\s+lua\b", "lua"),
    (r"^\s*#!\s*/bin/(?:bash|sh)\b", "shell"),
    (r"^\s*#!\s*/bin/zsh\b", "shell"),
    (r"^\s*<!DOCTYPE\s+html\b", "html"),
    (r"^\s*<\?xml\b", "xml"),
    (r"^\s*<html\b", "html"),
    (r"^\s*package\s+main\s*$", "go"),
    (r"^\s*func\s+\w+\s*\(", "go"),
    (r"^\s*fn\s+\w+\s*\(", "rust"),
    (r"^\s*pub\s+fn\s+\w+\s*\(", "rust"),
    (r'^\s*#include\s*[<"][^>"]*\.hpp[>"]|std::', "cpp"),
    (r'^\s*#include\s*[<"]', "c"),
    (r"^\s*def\s+\w+\s*\(", "python"),
    (r"^\s*class\s+\w+\s*\{[^}]*System\.out", "java"),
    (r"^\s*console\.log\(", "javascript"),
    (r"^\s*document\.", "javascript"),
    (r"^\s*SELECT\s+[\w*]+\s+FROM\s+\w+", "sql"),
    (r"^\s*\$\(", "shell"),
    (r"^\s*echo\s+", "shell"),
    (r"^\s*using\s+System", "cs"),
    (r"^\s*@import\s+", "css"),
    (r"^\s*\{\s*[\"']", "json"),
    (r"^\s*\[\s*[\"']", "json"),
    (r"^\s*\{\s*\}\s*$", "json"),
    (r"^\s*<\w+[^>]*>", "html"),
)
#: What a text must hold for a pattern to match, in the patterns' order; one of several where there are more.
LITERALS = (
    ("<?php",), ("#!",), ("#!",), ("#!",), ("#!",), ("#!",), ("#!",), ("#!",), ("#!",), ("<!DOCTYPE",), ("<?xml",), ("<html",), ("package",), ("func",), ("fn",), ("pub",),
    ("std::", ".hpp"), ("#include",), ("def",), ("System.out",), ("console.log(",), ("document.",), ("SELECT",), ("$(",), ("echo",), ("using",), ("@import",), ("{",), ("[",), ("{",), ("<",),
)
_COMPILED = [(re.compile(p, re.M), name) for p, name in LANGUAGES]


def detect_language(x: Column) -> Column:
    """The language, null where no pattern tells. A text is scanned by a pattern only if it holds the pattern's literal,
    which is a plain search of its bytes."""
    out = F
    for (pattern, name), literals in zip(LANGUAGES, LITERALS, strict=True):
        held = reduce(lambda a, b: a | b, [x.contains(t) for t in literals])
        out = out.when(held & x.rlike(f"(?mdU){pattern}"), name)
    return out


def detect_language_py(code: str) -> str | None:
    return next((name for p, name in _COMPILED if p.search(code)), None)
