"""Signature rules for licences, hand-written as one table of licences and one of phrases.

A rule is (priority, label, keywords, pattern): the pattern is tried only where all its keywords
stand in the lower-cased text. A lower priority number wins. In patterns a space means any run of
blanks and comment marks: patterns are tried on a text whose longer runs are shortened to as many
bytes as a space matches (``shortened``), which keeps their windows small. A dot crosses lines.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    priority: int
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    weight: float
    base: bool = False

    def reach(self) -> int:
        """The most bytes that a match can hold."""
        return min(re._parser.parse(self.pattern.pattern).getwidth()[1], 1 << 40)


#: Base phrases: their words stand consecutively, whatever separates them.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label | identifiers | names in prose | addresses
LICENCES = """
mit | mit | mit licen[sc]e; expat licen[sc]e; mit/x11 licen[sc]e | opensource\\.org/licenses?/mit
mit-0 | mit-0 | mit no attribution(?: licen[sc]e)? | opensource\\.org/licenses?/mit-0
apache-2.0 | apache-2\\.0 | apache licen[sc]e,? (?:version )?2(?:\\.0)?; apache software licen[sc]e,? (?:version )?2(?:\\.0)?; asl 2\\.0 | apache\\.org/licenses/license-2\\.0
apache-1.1 | apache-1\\.1 | apache (?:software )?licen[sc]e,? (?:version )?1\\.1 | apache\\.org/licenses/license-1\\.1
apache-1.0 | apache-1\\.0 | apache (?:software )?licen[sc]e,? (?:version )?1\\.0 | apache\\.org/licenses/license-1\\.0
gpl-3.0 | gpl-3\\.0(?:-only|-or-later|\\+)? | gnu general public licen[sc]e,? (?:version|v\\.?) ?3(?:\\.0)?; gnu gpl ?v?3; gplv3\\+? | gnu\\.org/licenses/gpl-3\\.0
gpl-2.0 | gpl-2\\.0(?:-only|-or-later|\\+)? | gnu general public licen[sc]e,? (?:version|v\\.?) ?2(?:\\.0)?; gnu gpl ?v?2; gplv2\\+? | gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0
gpl-1.0 | gpl-1\\.0(?:-only|-or-later|\\+)? | gnu general public licen[sc]e,? (?:version|v\\.?) ?1(?:\\.0)?; gplv1\\+? | gnu\\.org/licenses/old-licenses/gpl-1\\.0
lgpl-3.0 | lgpl-3\\.0(?:-only|-or-later|\\+)? | gnu lesser general public licen[sc]e,? (?:version|v\\.?) ?3(?:\\.0)?; gnu lgpl ?v?3; lgplv3\\+? | gnu\\.org/licenses/lgpl-3\\.0
lgpl-2.1 | lgpl-2\\.1(?:-only|-or-later|\\+)? | gnu lesser general public licen[sc]e,? (?:version|v\\.?) ?2\\.1; gnu lgpl ?v?2\\.1; lgplv2\\.1\\+? | gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1
lgpl-2.0 | lgpl-2\\.0(?:-only|-or-later|\\+)? | gnu library general public licen[sc]e,? (?:version|v\\.?) ?2(?:\\.0)?; lgplv2\\+? | gnu\\.org/licenses/old-licenses/lgpl-2\\.0
agpl-3.0 | agpl-3\\.0(?:-only|-or-later|\\+)? | gnu affero general public licen[sc]e(?:,? (?:version|v\\.?) ?3(?:\\.0)?)?; gnu agpl ?v?3; agplv3\\+? | gnu\\.org/licenses/agpl-3\\.0
gfdl-1.3 | gfdl-1\\.3(?:-only|-or-later|\\+)? | gnu free documentation licen[sc]e,? (?:version|v\\.?) ?1\\.3 | gnu\\.org/licenses/fdl-1\\.3
gfdl-1.2 | gfdl-1\\.2(?:-only|-or-later|\\+)? | gnu free documentation licen[sc]e,? (?:version|v\\.?) ?1\\.2 | gnu\\.org/licenses/(?:old-licenses/)?fdl-1\\.2
bsd-2-clause | bsd-2-clause | (?:simplified|freebsd|2-clause|two-clause) bsd licen[sc]e; bsd 2-clause licen[sc]e | opensource\\.org/licenses?/bsd-2-clause
bsd-3-clause | bsd-3-clause | (?:new|modified|revised|3-clause|three-clause) bsd licen[sc]e; bsd 3-clause licen[sc]e | opensource\\.org/licenses?/bsd-3-clause
bsd-4-clause | bsd-4-clause | (?:original|old|4-clause|four-clause) bsd licen[sc]e; bsd 4-clause licen[sc]e | directory\\.fsf\\.org/wiki/license:bsd(?:-|_)4clause
0bsd | 0bsd | (?:zero-clause|0-clause|free public) bsd licen[sc]e; bsd zero clause licen[sc]e | opensource\\.org/licenses?/0bsd
isc | isc | isc licen[sc]e; internet systems consortium licen[sc]e | opensource\\.org/licenses?/isc
mpl-2.0 | mpl-2\\.0 | mozilla public licen[sc]e,? (?:version|v\\.?) ?2(?:\\.0)?; mplv2 licen[sc]e | mozilla\\.org/mpl/2\\.0
mpl-1.1 | mpl-1\\.1 | mozilla public licen[sc]e,? (?:version|v\\.?) ?1\\.1 | mozilla\\.org/mpl/1\\.1
epl-2.0 | epl-2\\.0 | eclipse public licen[sc]e,? (?:version |v\\.? ?|- ?)?2(?:\\.0)? | eclipse\\.org/legal/epl-2\\.0
epl-1.0 | epl-1\\.0 | eclipse public licen[sc]e,? (?:version |v\\.? ?|- ?)?1(?:\\.0)? | eclipse\\.org/legal/epl-v10
cddl-1.0 | cddl-1\\.0 | common development and distribution licen[sc]e,? (?:version |v\\.? ?)?1\\.0 | opensource\\.org/licenses?/cddl-1\\.0
cddl-1.1 | cddl-1\\.1 | common development and distribution licen[sc]e,? (?:version |v\\.? ?)?1\\.1 | glassfish\\.dev\\.java\\.net/public/cddl
cpl-1.0 | cpl-1\\.0 | common public licen[sc]e,? (?:version |v\\.? ?)?1\\.0 | opensource\\.org/licenses?/cpl1\\.0
eupl-1.2 | eupl-1\\.2 | european union public licen[sc]e,? (?:version |v\\.? ?)?1\\.2 | joinup\\.ec\\.europa\\.eu/\\S{0,200}eupl-1\\.2
eupl-1.1 | eupl-1\\.1 | european union public licen[sc]e,? (?:version |v\\.? ?)?1\\.1 | joinup\\.ec\\.europa\\.eu/\\S{0,200}eupl-1\\.1
artistic-2.0 | artistic-2\\.0 | artistic licen[sc]e,? (?:version |v\\.? ?)?2(?:\\.0)? | opensource\\.org/licenses?/artistic-2\\.0
artistic-1.0 | artistic-1\\.0(?:-perl|-cl8)? | artistic licen[sc]e,? (?:version |v\\.? ?)?1(?:\\.0)? | opensource\\.org/licenses?/artistic-1\\.0
zlib | zlib | zlib licen[sc]e; zlib/libpng licen[sc]e | opensource\\.org/licenses?/zlib
bsl-1.0 | bsl-1\\.0 | boost software licen[sc]e(?:,? (?:- )?(?:version|v\\.?) ?1\\.0)? | boost\\.org/license_1_0
bsl-1.1 | busl-1\\.1 | business source licen[sc]e,? (?:version |v\\.? ?)?1\\.1 | mariadb\\.com/bsl11
unlicense | unlicense | the unlicense; unlicense licen[sc]e | unlicense\\.org
wtfpl | wtfpl | do what the f\\w{1,20} you want to public licen[sc]e; wtfpl licen[sc]e | wtfpl\\.net
cc0-1.0 | cc0-1\\.0 | cc0 1\\.0 universal; creative commons zero; cc0 licen[sc]e | creativecommons\\.org/publicdomain/zero/1\\.0
cc-by-4.0 | cc-by-4\\.0 | cc(?: |-)by(?: |-)4\\.0; creative commons attribution 4\\.0 | creativecommons\\.org/licenses/by/4\\.0
cc-by-3.0 | cc-by-3\\.0 | cc(?: |-)by(?: |-)3\\.0; creative commons attribution 3\\.0 | creativecommons\\.org/licenses/by/3\\.0
cc-by-2.0 | cc-by-2\\.0 | cc(?: |-)by(?: |-)2\\.0; creative commons attribution 2\\.0 | creativecommons\\.org/licenses/by/2\\.0
cc-by-sa-4.0 | cc-by-sa-4\\.0 | cc(?: |-)by-sa(?: |-)4\\.0; creative commons attribution-sharealike 4\\.0 | creativecommons\\.org/licenses/by-sa/4\\.0
cc-by-sa-3.0 | cc-by-sa-3\\.0 | cc(?: |-)by-sa(?: |-)3\\.0; creative commons attribution-sharealike 3\\.0 | creativecommons\\.org/licenses/by-sa/3\\.0
cc-by-nc-4.0 | cc-by-nc-4\\.0 | cc(?: |-)by-nc(?: |-)4\\.0; creative commons attribution-noncommercial 4\\.0 | creativecommons\\.org/licenses/by-nc/4\\.0
cc-by-nc-3.0 | cc-by-nc-3\\.0 | cc(?: |-)by-nc(?: |-)3\\.0; creative commons attribution-noncommercial 3\\.0 | creativecommons\\.org/licenses/by-nc/3\\.0
cc-by-nd-4.0 | cc-by-nd-4\\.0 | cc(?: |-)by-nd(?: |-)4\\.0; creative commons attribution-noderivatives 4\\.0 | creativecommons\\.org/licenses/by-nd/4\\.0
cc-by-nc-sa-4.0 | cc-by-nc-sa-4\\.0 | cc(?: |-)by-nc-sa(?: |-)4\\.0; creative commons attribution-noncommercial-sharealike 4\\.0 | creativecommons\\.org/licenses/by-nc-sa/4\\.0
cc-by-nc-nd-4.0 | cc-by-nc-nd-4\\.0 | cc(?: |-)by-nc-nd(?: |-)4\\.0; creative commons attribution-noncommercial-noderivatives 4\\.0 | creativecommons\\.org/licenses/by-nc-nd/4\\.0
odbl-1.0 | odbl-1\\.0 | open (?:data commons open )?database licen[sc]e | opendatacommons\\.org/licenses/odbl
odc-by-1.0 | odc-by-1\\.0 | open data commons attribution licen[sc]e | opendatacommons\\.org/licenses/by
pddl-1.0 | pddl-1\\.0 | public domain dedication (?:and|&) licen[sc]e | opendatacommons\\.org/licenses/pddl
ofl-1.1 | ofl-1\\.1 | sil open font licen[sc]e(?:,? (?:version|v\\.?) ?1\\.1)? | scripts\\.sil\\.org/ofl
python-2.0 | (?:python|psf)-2\\.0 | python software foundation licen[sc]e(?: version 2)?; psf licen[sc]e | docs\\.python\\.org/\\S{0,200}license
php-3.01 | php-3\\.01 | php licen[sc]e,? (?:version |v\\.? ?)?3\\.01 | php\\.net/license/3_01
postgresql | postgresql | postgresql licen[sc]e | opensource\\.org/licenses?/postgresql
ms-pl | ms-pl | microsoft public licen[sc]e | opensource\\.org/licenses?/ms-pl
ms-rl | ms-rl | microsoft reciprocal licen[sc]e | opensource\\.org/licenses?/ms-rl
ncsa | ncsa | (?:university of illinois/)?ncsa open source licen[sc]e | opensource\\.org/licenses?/ncsa
afl-3.0 | afl-3\\.0 | academic free licen[sc]e,? (?:version |v\\.? ?)?3\\.0 | opensource\\.org/licenses?/afl-3\\.0
osl-3.0 | osl-3\\.0 | open software licen[sc]e,? (?:version |v\\.? ?)?3\\.0 | opensource\\.org/licenses?/osl-3\\.0
vim | vim | vim licen[sc]e | vimhelp\\.org/uganda
ruby | ruby | ruby licen[sc]e | ruby-lang\\.org/\\S{0,200}license
openssl | openssl | openssl licen[sc]e; ssleay licen[sc]e | openssl\\.org/source/license
qpl-1.0 | qpl-1\\.0 | q public licen[sc]e | opensource\\.org/licenses?/qpl-1\\.0
cecill-2.1 | cecill-2\\.1 | cecill licen[sc]e,? (?:version |v\\.? ?)?2\\.1; cecill free software licen[sc]e agreement | cecill\\.info/licences/licence_cecill_v2\\.1
mulanpsl-2.0 | mulanpsl-2\\.0 | mulan permissive software licen[sc]e,? (?:version |v\\.? ?)?2 | license\\.coscl\\.org\\.cn/mulanpsl2
sspl-1.0 | sspl-1\\.0 | server side public licen[sc]e | mongodb\\.com/licensing/server-side-public-license
elastic-2.0 | elastic-2\\.0 | elastic licen[sc]e(?: 2\\.0)? | elastic\\.co/licensing/elastic-license
openrail-m | (?:bigscience|creativeml)-openrail-m | (?:creativeml )?open ?rail(?:\\+\\+)?-m licen[sc]e; responsible ai licen[sc]e | \\S{0,200}openrail-m
upl-1.0 | upl-1\\.0 | universal permissive licen[sc]e(?:,? (?:version |v\\.? ?)?1\\.0)? | oss\\.oracle\\.com/licenses/upl
blueoak-1.0.0 | blueoak-1\\.0\\.0 | blue oak model licen[sc]e | blueoakcouncil\\.org/license/1\\.0\\.0
"""

#: priority | label | keywords | pattern | weight; phrases of licence texts and notices without a name.
PHRASES = """
20 | mit | permission is hereby granted; free of charge | permission is hereby granted,? free of charge,? to any person obtaining a copy | 0.95
20 | mit | sell copies of the software | publish,? distribute,? sublicense,? and/or sell copies of the software | 0.9
20 | isc | permission to use, copy | permission to use, copy,? modify,? and(?:/or)? distribute this software for any purpose | 0.9
20 | bsd-3-clause | neither the name | neither the names? of .{1,120}?may be used to endorse or promote products | 0.9
21 | bsd-2-clause | redistribution and use | redistribution and use in source and binary forms,? with or without modification | 0.85
20 | bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display | 0.9
20 | zlib | altered source versions | altered source versions must be plainly marked as such | 0.9
20 | bsl-1.0 | boost software license | permission is hereby granted.{1,80}boost software license | 0.9
20 | unlicense | public domain | this is free and unencumbered software released into the public domain | 0.95
20 | wtfpl | what the | you just do what the f\\w{1,20} you want to | 0.9
20 | gpl | free software; redistribute it and/or modify | you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e | 0.9
20 | lgpl | redistribute it and/or modify | under the terms of the gnu lesser general public licen[sc]e | 0.9
20 | agpl | redistribute it and/or modify | under the terms of the gnu affero general public licen[sc]e | 0.9
22 | gpl-or-later | at your option | either version [123] of the licen[sc]e,? or \\(?at your option\\)? any later version | 0.8
20 | apache-2.0 | in compliance with the license | you may not use this file except in compliance with the licen[sc]e | 0.9
21 | apache-2.0 | conditions of any kind | distributed on an .as is. basis,? without warranties or conditions of any kind | 0.8
20 | mpl-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public licen[sc]e | 0.9
20 | epl | eclipse public | made available under the terms of the eclipse public licen[sc]e | 0.85
20 | cddl | common development | subject to the terms of the common development and distribution licen[sc]e | 0.85
21 | artistic | artistic license | same terms as perl itself,? .{0,60}artistic licen[sc]e | 0.8
20 | ofl-1.1 | font software | this font software is licensed under the sil open font licen[sc]e | 0.95
20 | cc0-1.0 | copyright and related | waived all copyright and related or neighbou?ring rights | 0.9
22 | cc-by | creative commons | licensed under (?:a |the )?creative commons attribution(?! ?-)(?: \\d\\.\\d)?(?: international)? licen[sc]e | 0.8
22 | cc-by-sa | creative commons | licensed under (?:a |the )?creative commons attribution-sharealike(?: \\d\\.\\d)?(?: international)? licen[sc]e | 0.8
22 | cc-by-nc | creative commons | licensed under (?:a |the )?creative commons attribution-noncommercial(?: \\d\\.\\d)?(?: international)? licen[sc]e | 0.8
23 | creative-commons | creative commons | creative commons(?: licen[sc]e)? | 0.5
23 | gpl | gnu gpl | gnu gpl | 0.6
23 | lgpl | gnu lgpl | gnu lgpl | 0.6
23 | agpl | gnu agpl | gnu agpl | 0.6
23 | bsd | bsd | bsd(?: |-)(?:style )?licen[sc]e(?:d)? | 0.6
23 | mpl | mozilla public | mozilla public licen[sc]e | 0.6
23 | eclipse | eclipse public | eclipse public licen[sc]e | 0.6
23 | artistic | artistic | artistic licen[sc]e | 0.6
23 | eupl | european union public | european union public licen[sc]e | 0.6
23 | cecill | cecill | cecill(?:-[abc])? licen[sc]e | 0.6
24 | public-domain | public domain | (?:released|placed|dedicated|is|are) (?:in|into|to)? ?the public domain | 0.6
24 | public-domain | no rights reserved | no rights reserved | 0.6
24 | public-domain | copyright; disclaim | authors? (?:hereby )?disclaims? copyright to this source code | 0.7
30 | proprietary | all rights reserved | all rights reserved | 0.4
30 | proprietary | proprietary and confidential | proprietary and confidential | 0.6
30 | proprietary | unauthori | unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of|or) | 0.5
30 | proprietary | written permission | without (?:the )?(?:prior |express )*written permission of | 0.4
30 | eula | end user license agreement | end(?: |-)user licen[sc]e agreement | 0.5
30 | eula | end-user license agreement | end(?: |-)user licen[sc]e agreement | 0.5
31 | commercial | commercial license | commercial licen[sc]e | 0.4
31 | non-commercial | non-commercial | for (?:personal |academic |research |educational |and |or |,|)*non-commercial (?:use|purposes) only | 0.5
31 | non-commercial | noncommercial | noncommercial use only | 0.5
31 | no-warranty | without warranty | without warranty of any kind | 0.3
31 | no-warranty | no warranty | comes with (?:absolutely )?no warranty | 0.3
32 | copyright-notice | copyright | copyright (?:\\(c\\)|\xc2\xa9)? ?\\d{4} | 0.3
40 | unknown-licence | licensed under | licensed under | 0.2
40 | unknown-licence | released under | released under (?:the|an?) .{1,60}?licen[sc]e | 0.2
40 | unknown-licence | license file | see (?:the )?(?:accompanying )?licen[sc]e(?:\\.txt|\\.md)? file | 0.2
40 | unknown-licence | spdx | spdx-license-identifier | 0.2
40 | unknown-licence | terms of | under the terms of (?:the|this) licen[sc]e | 0.2
"""

_GAP = rb"[\s*#/;|-]{1,8}"
_LONG_GAP = re.compile(rb"[\s*#/;|-]{9,}")
_WORD = rb"0-9a-z\x80-\xff"
_LEAD = re.compile(r"[a-z0-9]{3,}")


def _compiled(pattern: str) -> re.Pattern[bytes]:
    raw = pattern.encode("latin-1").replace(b" ", _GAP).replace(_GAP + b"?", b"(?:" + _GAP + b")?")
    return re.compile(rb"(?<![" + _WORD + rb"])(?:" + raw + rb")(?![" + _WORD + rb"])", re.DOTALL)


def shortened(text: bytes) -> tuple[bytes, list[int], list[int]]:
    """The text with every run of more than 8 blanks and marks cut to 8, and where pieces begin in it and in the text.

    A shortened run keeps its ends, and a blank between them if it holds one.
    """
    pieces, at, origin, size, last = [], [0], [0], 0, 0
    for m in _LONG_GAP.finditer(text):
        run = m.group()
        head = run[:4] + (b" " if run.split(maxsplit=1) != [run] else run[4:5])
        pieces += [text[last : m.start()], head]
        size += m.start() - last + len(head)
        last = m.end() - 3
        at.append(size)
        origin.append(last)
    return b"".join([*pieces, text[last:]]), at, origin


def _keyword(pattern: str) -> bytes:
    """The longest plain word that every match holds: one outside groups, classes and options."""
    plain = re.sub(r"\[[^\]]*\]|\\[a-zA-Z]\S?|\\.", " ", pattern)
    while (cut := re.sub(r"\([^()]*\)\??", " ", plain)) != plain:
        plain = cut
    plain = re.sub(r"\w\?", " ", plain)
    if "|" in plain:
        raise ValueError(f"alternatives outside a group: {pattern}")
    return max(_LEAD.findall(plain) or re.findall(r"[a-z0-9]{2,}", plain), key=len).encode()


def rules() -> list[Rule]:
    """All rules in order of priority: the base phrases, then identifiers, addresses, names and phrases."""
    out = []
    for phrase, label in BASE_PHRASES:
        words = [w.encode() for w in phrase.split()]
        joined = (rb"[^" + _WORD + rb"]+").join(words)
        pattern = re.compile(rb"(?<![" + _WORD + rb"])" + joined + rb"(?![" + _WORD + rb"])")
        out.append(Rule(f"base:{label}", 0, label, tuple(words), pattern, 0.7, True))
    for line in LICENCES.strip().splitlines():
        label, identifiers, names, urls = (x.strip() for x in line.split(" | "))
        out.append(Rule(f"id:{label}", 1, label, (b"spdx-license-identifier",), _compiled(f"spdx-license-identifier: ?(?:{identifiers})"), 1.0))
        out.append(Rule(f"field:{label}", 3, label, (b"license",), _compiled(f"\"?license\"? ?[:=] ?[\"']?(?:{identifiers})"), 0.9))
        out.append(Rule(f"url:{label}", 5, label, (_keyword(urls),), _compiled(f"(?:https?://)?(?:www\\.)?{urls}"), 0.95))
        for k, name in enumerate(names.split("; ")):
            out.append(Rule(f"under:{label}:{k}", 8, label, (b"under", _keyword(name)), _compiled(f"(?:licensed|released|distributed|available|provided) under (?:the (?:terms of the )?)?{name}"), 0.9))
            out.append(Rule(f"name:{label}:{k}", 10, label, (_keyword(name),), _compiled(name), 0.75))
    for k, line in enumerate(PHRASES.strip().splitlines()):
        priority, label, keywords, pattern, weight = (x.strip() for x in line.split(" | "))
        found = tuple(x.strip().encode() for x in keywords.split(";"))
        # A keyword of several words may be broken over lines in the text; its longest word may not.
        found = tuple(max(_LEAD.findall(x.decode()), key=len).encode() for x in found)
        out.append(Rule(f"text:{label}:{k}", int(priority), label, found, _compiled(pattern), float(weight)))
    return sorted(out, key=lambda r: r.priority)
