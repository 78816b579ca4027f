"""The ordered signature rules of the license scan.

A signature is a regex over normalised words (ASCII lower case, one blank
between words) with one word in braces: the keyword that gates it.  The part
before the braces has to end right before the keyword, the part after has to
start right after it, and neither may cut a word.  Signatures are chosen so that
the keyword is rare in prose (``license`` and not ``mit``, a common German
word).

Levels, highest first: 5 the wording of a license text, 4 a machine-readable
tag, 3 a grant that names a license, 2 a license name, 1 general notices.
"""

from __future__ import annotations

from typing import NamedTuple

#: Confidence of a detection by level.
SCORE = {5: 1.0, 4: 0.95, 3: 0.9, 2: 0.7, 1: 0.3}
LEVELS = len(SCORE)
#: Words of context that a signature may span on either side of its keyword.
BEFORE, AFTER = 12, 24

#: The phrases of the base count and their labels.
BASE = (
    ("gpl", "{gnu} general public license"),
    ("apache", "{apache} license"),
    ("cc-by", "{cc} by"),
    ("mit", "mit {license}"),
)

#: Wordings of license texts.
TEXTS = """
mit: permission is {hereby} granted free of charge to any person obtaining a copy
mit: copies of the software and to permit persons to whom the software is {furnished} to do so
mit: the above {copyright} notice and this permission notice shall be included in all copies or substantial portions
mit-0: permission is {hereby} granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
isc: permission to use copy modify and or {distribute} this software for any purpose with or without fee is hereby granted
0bsd: permission to use copy modify and or {distribute} this software for any purpose with or without fee is hereby granted( the software is provided)
bsd: {redistribution} and use in source and binary forms with or without modification are permitted
bsd: {redistributions} of source code must retain the above copyright notice
bsd: {redistributions} in binary form must reproduce the above copyright notice
bsd-3-clause: neither the name of( the)?( [^ ]+){1,8} nor the names of its {contributors} may be used to endorse or promote products
bsd-4-clause: all {advertising} materials mentioning features or use of this software must display
apache-2.0: you may not use this file except in {compliance} with the license
apache-2.0: you may obtain a copy of the license at http www {apache} org licenses license 2 0
apache-2.0: unless required by {applicable} law or agreed to in writing software distributed under the license
apache-1.1: this product includes software developed by the {apache} (software foundation|group)
gpl: free software you can {redistribute} it and or modify it under the terms of the gnu general public license
gpl-2.0: gnu general public license as published by the free software foundation either {version} 2 of the license
gpl-3.0: gnu general public license as published by the free software foundation either {version} 3 of the license
gpl: you should have received a copy of the {gnu} general public license
gpl: the licenses for most software( and other practical works)? are designed to take away your {freedom}
lgpl: free software you can {redistribute} it and or modify it under the terms of the gnu (lesser|library) general public license
lgpl: you should have received a copy of the {gnu} (lesser|library) general public license
lgpl-2.1: gnu lesser general public license as published by the free software foundation either {version} 2 1
lgpl-3.0: gnu lesser general public license as published by the free software foundation either {version} 3 of
agpl: free software you can {redistribute} it and or modify it under the terms of the gnu affero general public license
agpl: you should have received a copy of the {gnu} affero general public license
gfdl: permission is granted to copy {distribute} and or modify this document under the terms of the gnu free documentation license
gfdl: with no {invariant} sections( with)? no front cover texts
mpl-2.0: this source code form is subject to the terms of the {mozilla} public license v 2 0
mpl-2.0: if a copy of the {mpl} was not distributed with this file
mpl-1.1: the contents of this file are subject to the {mozilla} public license version 1 1
epl: this program and the accompanying materials are made available under the terms of the {eclipse} public license
cddl: the contents of this file are subject to the terms of the common {development} and distribution license
cpl: the accompanying program is provided under the terms of this common public {license}
artistic: the intent of this {document} is to state the conditions under which a package may be copied
artistic-2.0: everyone is permitted to copy and {distribute} verbatim copies of this license document but changing it is not allowed( preamble)? this license establishes the terms
zlib: this software is provided as is without any express or {implied} warranty in no event will the authors be held liable
zlib: altered source versions must be plainly marked as such and must not be {misrepresented}
bsl-1.0: permission is {hereby} granted free of charge to any person or organization obtaining a copy
unlicense: this is free and {unencumbered} software released into the public domain
unlicense: anyone is free to copy modify publish use {compile} sell or distribute this software
wtfpl: do what the {fuck} you want to
cc0: to the extent possible under law( [^ ]+){1,6} has {waived} all copyright and related( or neighboring)? rights
cc-by: you are free to share copy and redistribute the material in any medium or format( [^ ]+){0,4} {adapt}
cc-by-sa: if you {remix} transform or build upon the material you must distribute your contributions under the same license
cc-by-nd: if you {remix} transform or build upon the material you may not distribute the modified material
cc-by-nc: you may not use the material for {commercial} purposes
ofl: this font software is {licensed} under the sil open font license
ofl: the {fonts} and derivatives however cannot be released under any other type of license
psf: {psf} is making python available to licensee on an as is basis
openssl: this product includes software developed by the {openssl} project
json: the software shall be used for good not {evil}
beerware: you can buy me a {beer} in return
ms-pl: microsoft public license {ms} pl this license governs use of the accompanying software
upl: the {universal} permissive license upl version 1 0
eupl: this {european} union public licence
ncsa: the names of( [^ ]+){1,8} nor the names of its contributors may be used to {endorse} or promote products derived from this software without specific prior written permission the software
odbl: any use of this {database} is governed by( the)? open database license
openrail: use {restrictions} as referenced in paragraph 5
llama: llama materials( [^ ]+){0,4} {acceptable} use policy
proprietary: this (software|document|file|work) is the {confidential} and proprietary information
proprietary: {unauthorized} (copying|use|reproduction|distribution) of this (file|software|document|work)
proprietary: no part of this (publication|book|document|work) may be {reproduced}
"""

#: Names of licenses: label | SPDX words | names with the keyword in braces.
NAMES = """
mit | mit | mit {license} ; expat {license} ; mit x11 {license}
mit-0 | mit 0 | mit no attribution {license}
isc | isc | isc {license}
0bsd | 0bsd | zero clause bsd {license} ; {0bsd}( license)?
bsd | bsd | bsd {license} ; bsd style {license}
bsd-2-clause | bsd 2 clause | (simplified bsd|freebsd) {license} ; bsd 2 clause {license} ; 2 clause bsd {license}
bsd-3-clause | bsd 3 clause | (new|revised|modified) bsd {license} ; bsd 3 clause {license} ; 3 clause bsd {license}
bsd-4-clause | bsd 4 clause | original bsd {license} ; 4 clause bsd {license}
apache | apache | {apache} (software )?license ; {apache} licence
apache-1.1 | apache 1 1 | {apache} (software )?license (version )?v?1 1
apache-2.0 | apache 2 0 | {apache} (software )?license (version )?v?2( 0)? ; {apache} 2 0( license)? ; {asl} 2 0
gpl | gpl | {gnu} general public license ; {gnu} gpl ; {gpl} license
gpl-2.0 | gpl 2 0( only| or later)? | {gnu} general public license (version |v )?v?2( 0)? ; {gnu} gpl v?2 ; {gplv2} ; {gpl} (version |v )?2( 0)?
gpl-3.0 | gpl 3 0( only| or later)? | {gnu} general public license (version |v )?v?3( 0)? ; {gnu} gpl v?3 ; {gplv3} ; {gpl} (version |v )?3( 0)?
lgpl | lgpl | {gnu} (lesser|library) general public license ; {gnu} lgpl ; {lgpl} license
lgpl-2.1 | lgpl 2 1( only| or later)? | {gnu} lesser general public license (version |v )?v?2 1 ; {lgplv2} 1 ; {lgpl} (version |v )?2 1
lgpl-3.0 | lgpl 3 0( only| or later)? | {gnu} lesser general public license (version |v )?v?3( 0)? ; {lgplv3} ; {lgpl} (version |v )?3( 0)?
agpl | agpl | {gnu} affero general public license ; {affero} general public license ; {agpl} license
agpl-3.0 | agpl 3 0( only| or later)? | {gnu} affero general public license (version |v )?v?3( 0)? ; {agplv3} ; {agpl} (version |v )?3( 0)?
gfdl | gfdl 1 [123]( only| or later)? | {gnu} free documentation license ; {gfdl}
mpl-1.1 | mpl 1 1 | {mozilla} public license (version )?v?1 1 ; {mpl} 1 1
mpl-2.0 | mpl 2 0 | {mozilla} public license (version )?v?2( 0)? ; {mpl} 2 0
mpl | mpl | {mozilla} public license
epl-1.0 | epl 1 0 | {eclipse} public license (version )?v?1 0 ; {epl} 1 0
epl-2.0 | epl 2 0 | {eclipse} public license (version )?v?2( 0)? ; {epl} 2 0
epl | epl | {eclipse} public license
cddl | cddl 1 [01] | common {development} and distribution license ; {cddl}
cpl | cpl 1 0 | common public {license}
artistic | artistic 1 0 | {artistic} license
artistic-2.0 | artistic 2 0 | {artistic} license (version )?2 0
zlib | zlib | {zlib} license ; {zlib} libpng license
bsl-1.0 | bsl 1 0 | {boost} software license
busl | busl 1 1 | business source {license}
unlicense | unlicense | the {unlicense} ; {unlicense} license
wtfpl | wtfpl | {wtfpl}
cc0 | cc0 1 0 | {cc0} ; creative {commons} zero ; {cc} zero
cc-by | cc by( [1234] [05])? | {cc} by ; creative {commons} attribution( license)?
cc-by-sa | cc by sa( [1234] [05])? | {cc} by sa ; creative {commons} attribution share ?alike
cc-by-nd | cc by nd( [1234] [05])? | {cc} by nd ; creative {commons} attribution no ?deriv(ative|ative work|ate)?s?
cc-by-nc | cc by nc( [1234] [05])? | {cc} by nc ; creative {commons} attribution non ?commercial
cc-by-nc-sa | cc by nc sa( [1234] [05])? | {cc} by nc sa ; creative {commons} attribution non ?commercial share ?alike
cc-by-nc-nd | cc by nc nd( [1234] [05])? | {cc} by nc nd ; creative {commons} attribution non ?commercial no ?deriv(ative|ative work|ate)?s?
ofl | ofl 1 [01] | {sil} open font license ; open {font} license
psf | psf 2 0 | {psf} license ; python software foundation {license}
openssl | openssl | {openssl} license
json | json | json {license}
beerware | beerware | {beerware}
ms-pl | ms pl | microsoft public {license} ; {ms} pl
ms-rl | ms rl | microsoft reciprocal {license} ; {ms} rl
upl | upl 1 0 | {universal} permissive license
eupl | eupl 1 [012] | {european} union public licen[cs]e ; {eupl}
ncsa | ncsa | {ncsa} (open source )?license
odbl | odbl 1 0 | open {database} license ; {odbl}
odc-by | odc by 1 0 | open data commons attribution {license}
pddl | pddl 1 0 | public {domain} dedication and license ; {pddl}
openrail | openrail | {openrail}( m)?( license)?
llama | llama [23]( [1-4])? | llama [23]( [1-4])? community {license}
"""

#: Words of a grant, before a license name.
GRANT = ("(licensed|released|distributed|available|published|provided|covered|governed|issued|shared) "
         "(under|by) (the )?(terms of )?(the )?(conditions of )?(the )?")

#: General notices, which name no license.
NOTICES = """
copyright: {copyright} (c )?(19|20)[0-9][0-9]
copyright: {copyright} c
copyright: all rights {reserved}
copyright: c (19|20)[0-9][0-9]( [^ ]+){1,4} all rights {reserved}
licensed: {licensed} under( the)?( terms of)?( the)?( [^ ]+){1,3} licen[cs]e
licensed: see( the)? {license} file
licensed: see( the file)? {copying}
public-domain: (in|into) the public {domain}
public-domain: public {domain} (work|material|software|dedication)
no-license: no {license} is granted
permission: (used|reprinted|reproduced) with {permission}
"""


class Rule(NamedTuple):
    rule: int
    label: str
    keyword: str
    before: str
    after: str
    priority: int
    score: float
    base: bool


def _rule(number: int, label: str, signature: str, level: int, lead: str = "", base: bool = False) -> Rule:
    head, rest = signature.strip().split("{", 1)
    while not rest.split("}")[0].isalnum():  # a repeat count, not the keyword
        more, rest = rest.split("{", 1)
        head += "{" + more
    keyword, tail = rest.split("}", 1)
    return Rule(number, label, keyword, f" ({lead}{head})$", f"^({tail}) ", level, SCORE[level], base)


def _lines(table: str) -> list[str]:
    return [line for line in table.strip().splitlines() if line.strip()]


def build() -> list[Rule]:
    """All rules, numbered in their order."""
    specs: list[tuple] = [(label, s, 2, "", True) for label, s in BASE]
    specs += [(*line.split(": ", 1), 5) for line in _lines(TEXTS)]
    for line in _lines(NAMES):
        label, spdx, names = (x.strip() for x in line.split(" | "))
        specs.append((label, "{spdx} license identifier " + spdx, 4))
        specs += [(label, name, 3, GRANT) for name in names.split(" ; ")]
        specs += [(label, name, 2) for name in names.split(" ; ")]
    specs += [(*line.split(": ", 1), 1) for line in _lines(NOTICES)]
    return [_rule(i, *spec) for i, spec in enumerate(specs)]


RULES = build()
