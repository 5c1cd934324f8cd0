from random import Random

from newsloom.llm import licenses
from newsloom.llm.registry import op6_license_scan
from tests.llm.conftest import prose


def test_all_templates_are_found_anywhere():
    scan, r = licenses.Scanner(licenses.TEMPLATES), Random(6)
    for name, notice in licenses.TEMPLATES:
        for _ in range(40):
            before = prose(r.randint(1, 10**6), r.randint(0, 300)) + "\n"
            text = before + notice.upper() + "\n" + prose(r.randint(1, 10**6), r.randint(0, 300))
            hits = scan.scan(text)
            assert [(h[0], h[1]) for h in hits] == [(name, len(before))] and hits[0][3] == 1.0


def test_exact_containment_decides():
    scan = licenses.Scanner(licenses.TEMPLATES)
    long_ = dict((n, t) for n, t in licenses.TEMPLATES)["ISC"].split()
    assert scan.scan(" ".join(long_[:14])) == [] and scan.scan(" ".join(long_[:-2]))[0][0] == "ISC"
    assert [h[0] for h in scan.scan("This work is licensed under the GNU General Public License, version 3.")] == ["GPL-3.0"]
    assert scan.scan("the license of the work is released under the terms") == []


def test_odd_rows(spark, odd, none):
    assert licenses.scan_licenses(odd).collect() == [] and licenses.scan_licenses(none).collect() == []
    text = prose(1, 40_000) + " Released under the MIT License."
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [(r["license"], text[r["start"]:r["end"]]) for r in licenses.scan_licenses(docs).collect()] == [
        ("MIT", "Released under the MIT License")] * 2
    assert licenses.scan_licenses(docs, [("short", "two words")]).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"GPL-3.0": "this work is licensed under the gnu general public license, version 3",
             "CC-BY-NC-4.0": "licensed under cc by-nc 4.0", "MIT": "released under the mit license",
             "Apache-2.0": "licensed under the apache license, version 2.0"}
    want = sorted((r["doc_id"], n) for r in docs.collect() for n, x in lines.items()
                  for _ in range(r["text"].lower().count(x)))
    assert sorted((r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()) == want


def test_neighbouring_notices_are_each_found():
    scan = licenses.Scanner(licenses.TEMPLATES)

    def found(text):
        return [(n, text[a:b]) for n, a, b, _ in scan.scan(text)]

    mit, apache = "Licensed under the MIT License", "Licensed under the Apache License, Version 2.0"
    assert found(f"{mit}. {apache}.") == [("MIT", mit), ("Apache-2.0", apache)]
    assert found(f"{apache}. {mit}.") == [("Apache-2.0", apache), ("MIT", mit)]
    notices = [(n, t.rstrip(".")) for n, t in licenses.TEMPLATES]
    for one in notices:
        for other in notices:
            assert found(f"{one[1]}.\n{other[1]}.") == [one, other]
        assert found(" ".join([one[1]] * 5)) == [one] * 5


def test_neighbouring_altered_notices():
    scan = licenses.Scanner(licenses.TEMPLATES)
    isc = dict((n, t) for n, t in licenses.TEMPLATES)["ISC"].split()
    one, other = " ".join(isc[2:]), " ".join(isc[:-1])
    text = f"{one}. {other}."
    assert [text[a:b] for _, a, b, _ in scan.scan(text)] == [one, other]
    # A word put into a notice ends no place.
    text = " ".join([*isc[:-3], "always", *isc[-3:]])
    assert [text[a:b] for _, a, b, _ in scan.scan(text)] == [text]


def test_bare_rights_notices(spark):
    d = "/root/testdata/sf0.01"
    lines = {"GPL-3.0": "this work is licensed under the gnu general public license, version 3",
             "CC-BY-NC-4.0": "licensed under cc by-nc 4.0", "MIT": "released under the mit license",
             "Apache-2.0": "licensed under the apache license, version 2.0", "reserved": "all rights reserved"}
    want = sorted((r["doc_id"], n) for r in spark.read.parquet(f"{d}/documents.parquet").collect()
                  for n, x in lines.items() for _ in range(r["text"].lower().count(x)))
    assert sum(n == "reserved" for _, n in want) == 7
    assert sorted((r["doc_id"], r["license"]) for r in op6_license_scan(spark, d).collect()) == want


def test_rights_within_the_long_notice_are_one_place():
    scan = licenses.Scanner(licenses.TEMPLATES + licenses.RIGHTS)
    long_ = dict(licenses.TEMPLATES)["reserved"].rstrip(".")
    for notice in (long_, long_.replace(" may ", " may never ")):
        text = f"{notice}. All rights reserved."
        assert [text[a:b] for _, a, b, _ in scan.scan(text)] == [notice, "All rights reserved"]
    for i in range(40):
        text = f"{prose(i, i * 7)} ALL RIGHTS RESERVED {prose(i + 1, i)}"
        assert [(n, text[a:b]) for n, a, b, _ in scan.scan(text)] == [("reserved", "ALL RIGHTS RESERVED")]
