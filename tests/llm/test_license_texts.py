"""Whole license texts, notices of any layout and length, and inheritance by a plain loop over directories."""

import random

import pytest

from chronoweave.llm import licenses as li

APACHE = next(t for n, t in li.TEMPLATES if n == "Apache-2.0" and "you may not" in t)
MIT = next(t for n, t in li.TEMPLATES if n == "MIT" and t.startswith("Permission"))
PROSE = "the river ran past the mill and the old bridge while rain fell on the fields and nobody came to see it"


@pytest.mark.parametrize("length", [19_000, 19_990, 20_010, 60_000])
def test_a_repeated_notice_is_a_file_at_any_length(length):
    text = (APACHE + "\n") * (length // len(APACHE) + 1)
    assert li.declared(text[:length])[0] == "Apache-2.0" and li.declared(text[:length])[2]


@pytest.mark.parametrize("name", [n for n, _ in li.WHOLE])
def test_whole_texts_are_files(name):
    text = dict(li.WHOLE)[name].replace("Copyright (c)", "Copyright (c) 2021 Jane Roe and others")
    assert li.declared(text)[0] == name and li.declared(text)[2]
    assert li.declared("\n".join(text.split()))[::2] == (name, True)


@pytest.mark.parametrize("name,title", li.TITLES)
def test_long_licenses_are_known_by_their_title(name, title):
    assert li.declared(f"\n   {title.upper()}\n\n" + (PROSE + "\n") * 500) == (name, 1.0, True)
    assert not li.declared(f"{PROSE} {title}")[2]


def test_clause_of_its_own_makes_it_bsd_3():
    two, three = dict(li.WHOLE)["BSD-2-Clause"], dict(li.WHOLE)["BSD-3-Clause"]
    assert li.declared(f"{PROSE}. {three} {PROSE}")[::2] == ("BSD-3-Clause", False)
    assert li.declared(f"{PROSE}. {two} {PROSE}")[::2] == ("BSD-2-Clause", False)


def test_notices_of_any_layout():
    words = MIT.split()
    narrow = "\n".join(f" * {w}" for w in words)  # far more lines than a header has
    inline = f"{PROSE} {PROSE} {MIT} {PROSE} {PROSE} " * 2
    for text in (narrow, inline, "x " * 300_000 + MIT):
        name, score, whole = li.declared(text)
        assert name == "MIT" and score >= li.HEADER_COSINE, text[:50]
    assert li.declared(f"a license to print money, {PROSE}")[0] is None


def test_inheritance_by_a_plain_loop(spark):
    rng = random.Random(2)
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", None: PROSE}
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f/g"]
    rows = [(i, f"{rng.choice(folders)}/{rng.choice(['x.c', 'y.txt', 'LICENSE', 'COPYING.txt'])}".lstrip("/"), notices[rng.choice([*notices, None, None])], "k") for i in range(60)]
    rows += [(100, None, notices["MIT"], "k"), (101, None, PROSE, "k"), (102, "a/b/z", None, None), (103, "a//b/z", "", None), (103, "a//b/z", "", None)]
    df = spark.createDataFrame(rows, "id long, path string, text string, _near string")
    out = li.scan(df)
    assert out.columns == ["id", "path", "text", "_near", "license", "license_score", "license_from"]
    own = {n: li.declared(t or "") for n, t in notices.items()}
    held = {}
    for _, path, text, _ in rows:
        name = next((n for n, t in notices.items() if t == text and n), None)
        if path and name:
            folder = path.rpartition("/")[0]
            whole = own[name][2] or path.rpartition("/")[2] in ("LICENSE", "COPYING.txt")
            if whole:
                held.setdefault(folder, []).append((-own[name][1], name))
    for r in out.collect():
        name = next((n for n, t in notices.items() if t == r["text"] and n), None)
        want, how = name, "header"
        if name and r["path"] is not None and (own[name][2] or r["path"].rpartition("/")[2] in ("LICENSE", "COPYING.txt")):
            how = "file"
        if name is None:
            how = "none"
            parts = [p for p in (r["path"] or "").rpartition("/")[0].split("/") if p]
            for n in range(len(parts), -1, -1) if r["path"] is not None else ():
                if "/".join(parts[:n]) in held:
                    want, how = min(held["/".join(parts[:n])])[1], "inherited"
                    break
        assert (r["license"], r["license_from"]) == (want, how), r
    assert li.scan(df.limit(0)).count() == 0
