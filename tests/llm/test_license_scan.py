import math
import re
from collections import Counter

from textloom.llm.license_scan import LICENCE_FILE, license_scan
from textloom.llm.license_texts import TEMPLATES

SCHEMA = "path string, text string, license int"


def brute(files, threshold=0.7):
    """The same by plain loops: all units against all templates, and a walk up the folders."""
    words = lambda s: re.findall("[a-z0-9]+", (s or "").lower())
    held = Counter(t for _, text, _ in files for t in set(words(text)))
    known = {t for blocks in TEMPLATES.values() for b in blocks for t in words(b)}
    idf = lambda t: math.log((1 + len(files)) / (1 + (held[t] if t in known and held[t] else 1))) + 1

    def unit(text):
        v = {t: n * idf(t) for t, n in Counter(words(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    templates = [(name, unit(b)) for name in sorted(TEMPLATES) for b in [*TEMPLATES[name], " ".join(TEMPLATES[name])]]
    own = []
    for path, text, _ in files:
        units = (text or "").split("\n") + [b for b in re.split(r"\n[^\w\n]*\n", text or "") if "\n" in b]
        if path and re.match(LICENCE_FILE, path.split("/")[-1]):
            units.append(text or "")
        evidence = Counter()
        for u in units:
            mine = unit(u)
            for name in TEMPLATES:
                x = max(sum(y * v.get(t, 0) for t, y in mine.items()) for n, v in templates if n == name)
                if x >= threshold:
                    evidence[name] += x
        own.append(min(evidence, key=lambda n: (-round(evidence[n], 9), n), default=None))
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    out = []
    for (path, _, _), mine in zip(files, own):
        given, at = None, folder(path) if path is not None else None
        while mine is None and at is not None and given is None:
            here = sorted((p, o) for (p, _, _), o in zip(files, own) if p is not None and o and folder(p) == at and re.match(LICENCE_FILE, p.split("/")[-1]))
            given = here[0] if here else None
            at = folder(at) if at else None
        out.append((path, mine, mine or (given and given[1]), given and given[0]))
    return sorted(out, key=str)


def wrapped_lines(text, mark="", width=9):
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def files():
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(wrapped_lines(b) for b in TEMPLATES["MIT"][:3])
    gpl = "/*\n" + "\n *\n".join(wrapped_lines(b, " * ") for b in TEMPLATES["GPL-3.0"][:3]) + "\n */\n\nint main() { return 0; }\n"
    apache = "# Copyright 2020 Someone\n#\n" + "\n#\n".join(wrapped_lines(b, "# ") for b in TEMPLATES["Apache-2.0"][:2]) + "\n\nimport os\n"
    bsd = "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + "\n\n".join(wrapped_lines(b) for b in [TEMPLATES["BSD-2-Clause"][0], *TEMPLATES["BSD-2-Clause"][1:3], TEMPLATES["BSD-3-Clause"][0], TEMPLATES["BSD-2-Clause"][3]])
    return [
        ("mit/LICENSE", mit, 1), ("mit/src/a.py", "print(1)\n", 1), ("mit/src/gpl.c", gpl, 1), ("mit/src/apache.py", apache, 1),
        ("bsd/COPYING", bsd, 1), ("bsd/x", None, 1), ("bsd/x", "", 1), ("mit/src/licenses.txt", "we like a license\nof some kind", 1),
        ("none/y.txt", "plain words " * 50, None), (None, "plain", 1), (None, TEMPLATES["MIT"][3], 1), ("", "no path but empty", 1), ("top.txt", "at the top", 1),
        ("mit/long.txt", "words and more words of it\n" * 3000 + "Released under the MIT License.\n" + "so it goes " * 3000, 1), ("mit/src/deep/er/z", "zz", 1), ("mit/src/deep/NOTICE.md", gpl, 1),
        ("mit/src/a.py", "print(1)\n", 1),
    ]


def test_matches_plain_loops(spark):
    rows = files()
    found = license_scan(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found.columns == ["path", "text", "own_license", "own_score", "license", "inherited_from"]
    got = sorted(((r.path, r.own_license, r.license, r.inherited_from) for r in found.collect()), key=str)
    assert got == brute(rows)


def test_real_texts_are_found(spark):
    got = {(r.path, r.license, r.inherited_from) for r in license_scan(spark.createDataFrame(files(), SCHEMA)).collect()}
    assert ("mit/LICENSE", "MIT", None) in got and ("mit/src/gpl.c", "GPL-3.0", None) in got and ("mit/src/apache.py", "Apache-2.0", None) in got
    assert ("mit/src/a.py", "MIT", "mit/LICENSE") in got and ("mit/src/deep/er/z", "GPL-3.0", "mit/src/deep/NOTICE.md") in got
    assert ("mit/src/licenses.txt", "MIT", "mit/LICENSE") in got and ("none/y.txt", None, None) in got and (None, "MIT", None) in got
    assert {l.split("-")[0] for p, l, _ in got if p in ("bsd/COPYING", "bsd/x")} == {"BSD"}


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
