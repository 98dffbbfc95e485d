from faultline.llm import license_scan, queries
from llm.helpers import ODD, docs, matches_oracle

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
       "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
       "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
       "is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
       "included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
       "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
       "NONINFRINGEMENT.")


def test_sentences_and_rules(spark):
    rows = [(1, MIT), (2, "Intro. Released under the MIT License. More"), (3, MIT.replace("substantial", "many")),
            (4, "Licensed under the Apache License, Version 2.0.\nx\nReleased under the MIT License."),
            (5, "Released under the MIT License.\nReleased under the MIT License."), (6, "the mit license"),
            (7, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance "
                "with the License."), (8, "x " * 50_000 + "\nAll rights reserved.")]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert [got[k]["licenses"] for k in range(1, 9)] == ["MIT", "MIT", "", "Apache-2.0,MIT", "MIT", "", "Apache-2.0", "Proprietary"]
    assert (got[1]["n_sentences"], got[1]["n_unresolved"]) == (3, 0)
    assert (got[3]["n_sentences"], got[3]["n_unresolved"]) == (2, 2)
    assert got[5]["identifiers"] == "<mit-reference><mit-reference>"


def test_odd_rows(spark):
    got = license_scan.scan(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r["licenses"] for r in got} == {""}
    assert license_scan.scan(docs(spark, ODD).limit(0)).count() == 0


def test_rules_use_known_identifiers():
    assert {i for _, ids in license_scan.RULES for i in ids} <= set(license_scan.SENTENCES.values())


def test_query_matches_sql(spark):
    matches_oracle(spark, queries.QUERIES["op1_license_scan"], queries.ORACLES["op1_license_scan"])
