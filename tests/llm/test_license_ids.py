from tidebar.llm import licenses

IDS = {
    "MIT": "mit", "Apache-2.0": "apache-2.0", "Apache-1.1": "apache-1.1", "ISC": "isc", "Zlib": "zlib", "BSL-1.0": "boost", "EPL-2.0": "epl", "CDDL-1.0": "cddl", "EUPL-1.2": "eupl", "Artistic-2.0": "artistic", "OFL-1.1": "ofl",
    "GPL-2.0-only": "gpl-2.0", "GPL-2.0-or-later": "gpl-2.0", "GPL-3.0": "gpl-3.0", "LGPL-2.1-or-later": "lgpl", "AGPL-3.0-only": "agpl", "GFDL-1.3-only": "gfdl", "X11": "x11", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "BSD-4-Clause": "bsd",
    "MPL-2.0": "mpl-2.0", "MPL-1.1": "mpl", "CPL-1.0": "cpl", "Unlicense": "unlicense", "WTFPL": "wtfpl", "CC0-1.0": "cc0", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-ND-4.0": "cc-by-nd", "CC-BY-NC-SA-4.0": "cc-by-nc-sa", "CC-BY-NC-ND-4.0": "cc-by-nc-nd",
    "ODbL-1.0": "odbl", "ODC-By-1.0": "odc-by", "MS-PL": "ms-pl", "PSF-2.0": "python",
}


def test_identifiers(spark):
    texts = {f"// SPDX-License-Identifier: {i}\nint main() {{}}": x for i, x in IDS.items()} | {f"This file is licensed under {i}, see LICENSE.": x for i, x in IDS.items()}
    texts |= {"SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2.0,mit", "code under Apache 2.0 here": "apache-2.0", "GPLv2 code": "gpl-2.0", "he went to mit and wrote zlib in python": "", "gnu gpl 3 0": "gpl-3.0"}
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        text, want = list(texts.items())[r.doc_id]
        assert set(r.labels.split(",")) - set(r.base_labels.split(",")) >= set(want.split(",")) - set(r.base_labels.split(",")) - {""}, (text, r.labels)
        assert set(r.labels.split(",")) <= {*want.split(","), *r.base_labels.split(",")}, (text, r.labels)
        assert (r.score > 0) == bool(want)
