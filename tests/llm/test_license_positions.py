"""License scans of notices at any position."""

import random

import brute
from hallwatch.llm import license_scan


def every_start(text):
    """Largest containment of each template among its matching blocks."""
    w, out = brute.license_words(text), {}
    for name, template in license_scan.TEMPLATES.items():
        best = max(brute.license_blocks(w, template, license_scan.THRESHOLD, license_scan.REQUIRED.get(name, "")), default=None)
        if best:
            out[name] = best
    return out


def test_a_notice_is_found_wherever_it_stands(spark):
    rnd, rows = random.Random(5), []
    for k in range(12):
        rows.append((k, "w " * k + "released x y under z the MIT license tail tail tail tail tail tail"))
    for k in range(100, 300):
        words = rnd.choice(list(license_scan.TEMPLATES.values())).split()
        for _ in range(rnd.randint(0, len(words))):
            words.insert(rnd.randint(0, len(words)), rnd.choice(["filler", "the", "2024"]))
        rows.append((k, "x " * rnd.randint(0, 30) + " ".join(words) + " y" * rnd.randint(0, 30)))
    got = {r.doc_id: r.matches for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        best = {}
        for m in got[i]:
            best[m.template] = max(best.get(m.template, 0), m.containment)
        assert best == every_start(text)
    assert all("mit" in {m.template for m in got[k]} for k in range(12))


def test_kin_of_a_notice_are_not_taken_for_it(spark):
    other = {"Licensed under CC BY 4.0": "cc-by", "GNU General Public License, version 2": "gpl", "released under the GPL license": "", "Released under the BSD License": "",
             "We released the new album under a license": "", "Licensed under the EPL License, Version 2.0": "", "This work is licensed under the GNU General Public License, version 2": "gpl"}
    same = {"Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc", "This software is released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0 (the License)": "apache-2.0",
            "it is licensed under GNU General Public License version 3, that work": "gpl,gpl-3.0"}
    texts = {**other, **same}
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(texts.values()))
