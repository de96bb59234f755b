import random
import re

import numpy as np

from docloom.llm import license_scan as ls


def brute_force(text, templates=ls.TEMPLATES):
    """Licenses of which some window of their class holds enough shingles."""
    words, found = re.findall(r"[^\W_]+", (text or "").lower()), {}
    for name, template in templates:
        t = re.findall(r"[^\W_]+", template.lower())
        k = min(5, len(t))
        if not k:
            continue
        own = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        w = 1 << (len(t) - k).bit_length()
        sequence = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        for at in range(0, len(sequence), max(1, w // 2)):
            share = len(own & set(sequence[at : at + w + w // 2])) / len(own)
            if share >= 0.8:
                found[name] = max(found.get(name, 0), share)
    return found


def test_equals_brute_force_with_edits():
    rng, scanner = random.Random(2), ls.Scanner(ls.TEMPLATES)
    missed = total = 0
    for _ in range(300):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(400))]
        for _ in range(rng.randrange(3)):
            template = rng.choice(ls.TEMPLATES)[1].split()
            if len(template) > 20 and rng.random() < 0.5:
                template[rng.randrange(len(template))] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = template
        text = " ".join(words)
        want, got = brute_force(text), {n: s for n, s, _ in scanner.scan(text)}
        assert all(np.isclose(want[n], s) for n, s in got.items())
        missed, total = missed + len(set(want) - set(got)), total + len(want)
    assert missed <= 0.01 * total


def test_recall_against_containment_without_windows():
    """Passages as long as a template, at any place, that hold 0.8 or more of its shingles: nearly all are found."""
    rng, scanner = random.Random(9), ls.Scanner(ls.TEMPLATES)
    long = [k for k, size in enumerate(map(len, scanner.sets)) if size >= 8]
    missed = total = 0
    for _ in range(400):
        k = rng.choice(long)
        template = re.findall(r"[^\W_]+", ls.TEMPLATES[k][1].lower())
        for _ in range(rng.randrange(1 + len(template) // 40)):
            template[rng.randrange(len(template))] = "edited"
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(900))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = template
        text = " ".join(words)
        shingles = scanner.shingles(scanner.hashes(text), scanner.widths[k])
        w = 1 << (len(scanner.shingles(scanner.hashes(ls.TEMPLATES[k][1]), scanner.widths[k])) - 1).bit_length()
        best = max(np.isin(scanner.sets[k], shingles[i : i + w]).mean() for i in range(max(0, at - 3), min(at + 4, len(shingles))))
        if best >= 0.8:
            total += 1
            missed += scanner.names[k] not in {n for n, _, _ in scanner.scan(text)}
    assert total > 200 and missed <= 0.01 * total


def test_bands_reach_the_probability():
    for j in (0.2, 0.5, 0.9):
        assert (1 - j) ** ls.bands_for(j) <= ls.MISS
    assert ls.bands_for(1.0) == 1


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = ls.op8_license_scan(docs).collect()
    assert sum(r["n_licenses"] for r in rows) > 0
    assert all(r["licenses"] == ",".join(sorted(brute_force(texts[r["doc_id"]]))) for r in rows)


def test_odd_rows(odd, empty):
    out = ls.op8_license_scan(odd)
    assert out.count() == 14 and out.where("n_licenses <> 0 OR licenses <> '' OR best_share <> 0").count() == 0
    assert ls.op8_license_scan(empty).count() == 0
    assert ls.find_licenses(odd, templates=(("none", ""), ("a", "lazy dog"), ("b", "lazy dog"))).where("get(_found.licenses, 1).name = 'b'").count() == 6


def test_full_texts_and_notices_of_neighbouring_licenses():
    scanner = ls.Scanner(ls.TEMPLATES)
    found = lambda text: [n for n, _, _ in scanner.found(text)]
    full = {name: text for name, text in reversed(ls.TEMPLATES) if len(text) > 600}
    assert {"Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "MPL-2.0", "CC-BY-SA-4.0"} <= set(full)
    for name, text in full.items():
        words = text.split()
        words[len(words) // 2] = "edited"
        assert found(f"some words before it {' '.join(words)} and some after it") == [name]
    notice = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
    assert found(notice.format(";", "", ";", 2)) == ["GPL-2.0"] and found(notice.format(":", "", ",", 3)) == ["GPL-3.0"] and found(notice.format(":", "Affero ", ",", 3)) == ["AGPL-3.0"]
    for text, want in (("It is licensed under the MIT License, as is usual", "MIT"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("Made available under the Eclipse Public License v2.0.", "EPL-2.0"), ("under the terms of the GNU General Public License, version 3", "GPL-3.0")):
        assert found(text) == [want]
    assert found(full["MIT"] + " " + "word " * 400 + full["BSD-2-Clause"]) == ["BSD-2-Clause", "MIT"]
    assert [n for n, _, _ in ls.Scanner((("a", "one two three four five six"), ("b", "one two three four five six"))).found("one two three four five six")] == ["a", "b"]
