"""The catalogue of known licences: whole texts, their usual titles, notices, and identifier lines.

Whole texts lie in ``licenses``, one file a licence; ``licenses/spdx_ids.txt`` has every SPDX identifier.
"""

from __future__ import annotations

import re
from pathlib import Path

FOLDER = Path(__file__).parent / "licenses"
#: Licences whose title, the first paragraph of the file, is often left out.
UNTITLED = ["BSL-1.0", "Zlib"]
#: Names by which notices call a licence.
NAMES = {
    "MIT": ["MIT", "MIT License", "Expat License"],
    "ISC": ["ISC", "ISC License"],
    "Apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache 2.0 License", "Apache License 2.0", "Apache License, Version 2.0", 'Apache License, Version 2.0 (the "License")'],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License", "BSD-2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License", "BSD-3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "MPL-2.0": ["MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "Unlicense": ["Unlicense"],
    "BSL-1.0": ["BSL-1.0", "Boost Software License", "Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Zlib": ["zlib License"],
    "EPL-2.0": ["EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License - v 2.0"],
    "OFL-1.1": ["OFL-1.1", "SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
}
for _short, _long in (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"), ("AGPL", "Affero General Public License"), ("GFDL", "Free Documentation License")):
    for _v in {"GPL": "2.0 3.0", "LGPL": "2.1 3.0", "AGPL": "3.0", "GFDL": "1.2 1.3"}[_short].split():
        _forms = dict.fromkeys([_v, _v.removesuffix(".0")])
        NAMES[f"{_short}-{_v}"] = [f"{a}{b}" for n in _forms for b in (f" version {n}", f" v{n}", f"v{n}", f" {n}", f" version {n} or later", f" version {n} or any later version", f" version {n} only") for a in (_short, f"GNU {_short}", f"GNU {_long}")]
for _code, _words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v, _port in (("4.0", "International"), ("3.0", "Unported")):
        NAMES[f"CC-{_code}-{_v}"] = [f"CC-{_code}-{_v}", f"CC {_code} {_v}", *(f"{a}{_words} {_v}{b}{c}" for a in ("", "Creative Commons ") for b in ("", f" {_port}") for c in ("", " License")), f"Creative Commons {_words} {_v} {_port} License (CC {_code} {_v})"]
NOTICES = [f"{who}{how} {the}{{}}" for who in ("", *(f"This {x} is " for x in ("work", "project", "software", "program", "file"))) for how in ("licensed under", "released under", "distributed under") for the in ("", "the ")]
NOTICES += ["License: {}", "Available under the {}", "Available under the terms of the {}"]


def family(identifier: str) -> str:
    """The licence of an SPDX identifier: GNU ones go without "only", "or later" and plus."""
    return re.sub(r"(-only|-or-later|\+)$", "", identifier) if re.match(r"A?L?GPL|GFDL", identifier) else identifier


def _bsd() -> list[tuple[str, str]]:
    two = (FOLDER / "BSD-2-Clause.txt").read_text().replace("Copyright (c) <year> <owner>", "").strip()
    head, one, second, warranty = [p.strip() for p in two.split("\n\n") if p.strip()]
    out = []
    for owner in ("", "OWNER"):
        said = warranty.replace("SHALL THE COPYRIGHT HOLDER OR", "SHALL THE COPYRIGHT OWNER OR") if owner else warranty
        assert (said != warranty) == bool(owner)
        for third in ("", "copyright holder nor the names of its", "copyright holders nor the names of its", "copyright holder nor the names of", "author nor the names of its", "copyright owner nor the names of its"):
            use = [f"3. Neither the name of the {third} contributors may be used to endorse or promote products derived from this software without specific prior written permission."] if third else []
            for numbered in (True, False):
                parts = [one, second, *use]
                name = "BSD-3-Clause" if third else "BSD-2-Clause"
                body = "\n\n".join([head, *(parts if numbered else [p[3:] for p in parts]), said])
                out += [(name, t + body) for t in ("", f"{name.replace('BSD-', 'BSD ')} License\n\n", f"The {name.replace('BSD-', 'BSD ')} License\n\n", f"{name} License\n\n")]
    return out


def texts() -> list[tuple[str, str]]:
    """(license, text) of whole texts."""
    out = _bsd()
    for path in sorted(FOLDER.glob("*.txt")):
        if path.stem in ("spdx_ids", "BSD-2-Clause"):
            continue
        text = path.read_text()
        out.append((path.stem, text))
        if path.stem in UNTITLED:
            out.append((path.stem, text.partition("\n\n")[2]))
        end = "END OF TERMS AND CONDITIONS"
        if end in text:  # often given without the appendix on how to apply it
            out += [(path.stem, text[: text.index(end)]), (path.stem, text[: text.index(end)] + end)]
    return out


def notices() -> list[tuple[str, str]]:
    """(license, line) of notices and identifiers."""
    out = [(family(i), f"SPDX-License-Identifier: {i}") for i in (FOLDER / "spdx_ids.txt").read_text().split()]
    return out + [(name, notice.format(called)) for name, names in NAMES.items() for called in names for notice in NOTICES]
