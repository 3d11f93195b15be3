"""Signature rules for license scans: a table of families, the forms they are named in, and sentences of license texts.

Patterns are read over normalised text: lower-case words with one space between them, no marks (``GPL-3.0`` is
``gpl 3 0``). A rule has a keyword that every match contains; rules with the same keyword are looked at only where it
occurs. Order is rank: of equal rules the earlier one counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TEXT, TAG, URL, GRANT, VERSIONED, NAME, HINT = 100, 90, 80, 70, 60, 40, 10
CONFIDENCE = {TEXT: 1.0, TAG: 0.98, URL: 0.95, GRANT: 0.9, VERSIONED: 0.8, NAME: 0.6, HINT: 0.2}

# Public license families. label | keyword | name | versions | tag | url
FAMILIES = """
apache | apache | apache(?: software)?(?: foundation)? licen[cs]e | 1.0 1.1 2.0 | apache | apache org licen[cs]es license
mit | mit licen | (?:expat |x11 )?mit licen[cs]e | | mit | opensource org licen[cs]es? mit
mit | mit x11 | mit x11 licen[cs]e | | mit | spdx org licen[cs]es mit
mit | mit expat | mit expat licen[cs]e | | mit | mit license org
mit-0 | mit no | mit no attribution(?: licen[cs]e)? | | mit 0 | opensource org licen[cs]es? mit 0
x11 | x11 | x11 licen[cs]e | | x11 | xfree86 org 3 3 6 copyright2
bsd | bsd | (?:berkeley |original |open )?bsd(?: style)? licen[cs]e | | bsd | opensource org licen[cs]es? bsd license
bsd-0-clause | bsd | (?:bsd 0 clause|0 clause bsd|zero clause bsd)(?: licen[cs]e)? | | 0bsd | opensource org licen[cs]es? 0bsd
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)? | | bsd 2 clause | opensource org licen[cs]es? bsd 2 clause
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)? | | bsd 3 clause | opensource org licen[cs]es? bsd 3 clause
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)? | | bsd 4 clause | spdx org licen[cs]es bsd 4 clause
gpl | gpl | (?:gnu )?gpl | 1.0 2.0 3.0 | gpl | gnu org licen[cs]es(?: old licen[cs]es)? gpl
gpl | general public | (?:gnu )?general public licen[cs]e | 1.0 2.0 3.0 | gpl | gnu org copyleft gpl
lgpl | lgpl | (?:gnu )?lgpl | 2.0 2.1 3.0 | lgpl | gnu org licen[cs]es(?: old licen[cs]es)? lgpl
lgpl | general public | (?:gnu )?(?:lesser|library)(?: or lesser)? general public licen[cs]e | 2.0 2.1 3.0 | lgpl | gnu org copyleft lesser
agpl | agpl | (?:gnu )?agpl | 1.0 3.0 | agpl | gnu org licen[cs]es agpl
agpl | affero | (?:gnu )?affero general public licen[cs]e | 1.0 3.0 | agpl | affero org oagpl
gfdl | free documentation | (?:gnu )?free documentation licen[cs]e | 1.1 1.2 1.3 | gfdl | gnu org licen[cs]es fdl
mpl | mozilla | mozilla public licen[cs]e | 1.0 1.1 2.0 | mpl | mozilla org mpl
epl | eclipse | eclipse public licen[cs]e | 1.0 2.0 | epl | eclipse org legal epl
edl | eclipse | eclipse distribution licen[cs]e | 1.0 | edl | eclipse org org documents edl
cddl | common development | common development and distribution licen[cs]e | 1.0 1.1 | cddl | opensource org licen[cs]es? cddl
cpl | common public | common public licen[cs]e | 1.0 | cpl | opensource org licen[cs]es? cpl
cpal | common public | common public attribution licen[cs]e | 1.0 | cpal | opensource org licen[cs]es? cpal
ipl | ibm | ibm public licen[cs]e | 1.0 | ipl | opensource org licen[cs]es? ibmpl
eupl | european union | european union public licen[cs]e | 1.0 1.1 1.2 | eupl | joinup ec europa eu(?: [^ ]{1,40}){0,4} eupl
artistic | artistic | artistic licen[cs]e | 1.0 2.0 | artistic | opensource org licen[cs]es? artistic license
perl | perl | (?:same terms as|licen[cs]e as) perl(?: itself)? | | artistic 1 0 perl | dev perl org licen[cs]es
php | php | php licen[cs]e | 3.0 3.01 | php | php net license
python | python | python(?: software foundation)? licen[cs]e | 2.0 | psf | docs python org(?: [^ ]{1,40}){0,2} license
ruby | ruby | ruby(?: s)? licen[cs]e | | ruby | ruby lang org(?: en)?(?: about)? license
zlib | zlib | zlib(?: libpng)? licen[cs]e | | zlib | zlib net zlib license
libpng | libpng | libpng licen[cs]e | 2.0 | libpng | libpng org pub png src libpng license
openssl | openssl | openssl(?: ssleay)? licen[cs]e | | openssl | openssl org source license
isc | isc | isc licen[cs]e | | isc | opensource org licen[cs]es? isc
unlicense | unlicense | (?:the )?unlicense | | unlicense | unlicense org
wtfpl | wtfpl | wtfpl(?: licen[cs]e)? | 1.0 2.0 | wtfpl | wtfpl net
boost | boost | boost software licen[cs]e | 1.0 | bsl | boost org license
busl | business source | business source licen[cs]e | 1.1 | busl | mariadb com bsl11
ms-pl | microsoft public | microsoft public licen[cs]e | | ms pl | opensource org licen[cs]es? ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e | | ms rl | opensource org licen[cs]es? ms rl
ofl | open font | (?:sil )?open font licen[cs]e | 1.0 1.1 | ofl | scripts sil org ofl
osl | open software | open software licen[cs]e | 1.0 2.0 2.1 3.0 | osl | opensource org licen[cs]es? osl
afl | academic free | academic free licen[cs]e | 1.1 1.2 2.0 2.1 3.0 | afl | opensource org licen[cs]es? afl
ecl | educational community | educational community licen[cs]e | 1.0 2.0 | ecl | opensource org licen[cs]es? ecl
qpl | q public | q public licen[cs]e | 1.0 | qpl | opensource org licen[cs]es? qtpl
sleepycat | sleepycat | sleepycat licen[cs]e | | sleepycat | opensource org licen[cs]es? sleepycat
zpl | zope | zope public licen[cs]e | 2.0 2.1 | zpl | zope org resources zpl
w3c | w3c | w3c software(?: notice and)?(?: and document)? licen[cs]e | | w3c | w3 org consortium legal copyright software
ncsa | ncsa | (?:university of illinois )?(?:uiuc )?ncsa(?: open source)? licen[cs]e | | ncsa | otm illinois edu uiuc opensource
postgresql | postgresql | postgresql licen[cs]e | | postgresql | postgresql org about licence
vim | vim | vim licen[cs]e | | vim | vimdoc sourceforge net htmldoc uganda
curl | curl | curl licen[cs]e | | curl | curl se docs copyright
icu | icu | icu licen[cs]e | | icu | source icu project org(?: [^ ]{1,40}){0,4} license
unicode | unicode | unicode licen[cs]e(?: agreement)? | | unicode dfs 2016 | unicode org copyright
json | json | json licen[cs]e | | json | json org license
beerware | beerware | beerware licen[cs]e | | beerware | people freebsd org phk
odbl | open database | open database licen[cs]e | 1.0 | odbl | opendatacommons org licen[cs]es odbl
odc-by | open data commons | open data commons attribution licen[cs]e | 1.0 | odc by | opendatacommons org licen[cs]es by
pddl | open data commons | open data commons public domain dedication(?: and)? licen[cs]e | 1.0 | pddl | opendatacommons org licen[cs]es pddl
cecill | cecill | cecill(?: licen[cs]e)? | 1.0 1.1 2.0 2.1 | cecill | cecill info licen[cs]es
cecill-b | cecill | cecill b(?: licen[cs]e)? | | cecill b | cecill info licen[cs]es licen[cs]e cecill b
cecill-c | cecill | cecill c(?: licen[cs]e)? | | cecill c | cecill info licen[cs]es licen[cs]e cecill c
upl | universal permissive | universal permissive licen[cs]e | 1.0 | upl | oss oracle com licen[cs]es upl
sspl | server side public | server side public licen[cs]e | 1.0 | sspl | mongodb com licensing server side public license
elastic | elastic | elastic licen[cs]e | 1.0 2.0 | elastic | elastic co licensing elastic license
apsl | apple public | apple public source licen[cs]e | 1.0 1.1 1.2 2.0 | apsl | opensource apple com apsl
npl | netscape | netscape public licen[cs]e | 1.0 1.1 | npl | mozilla org npl
nokia | nokia | nokia open source licen[cs]e | 1.0 | nokia | opensource org licen[cs]es? nokia
rpl | reciprocal public | reciprocal public licen[cs]e | 1.1 1.5 | rpl | opensource org licen[cs]es? rpl
sissl | sun industry | sun industry standards source licen[cs]e | 1.1 | sissl | openoffice org licen[cs]es sissl
spl | sun public | sun public licen[cs]e | 1.0 | spl | opensource org licen[cs]es? sunpublic
lppl | latex project | latex project public licen[cs]e | 1.0 1.1 1.2 1.3 | lppl | latex project org lppl
openldap | openldap | openldap public licen[cs]e | 2.7 2.8 | oldap | openldap org software release license
hpnd | historical permission | historical permission notice and disclaimer | | hpnd | opensource org licen[cs]es? hpnd
imagemagick | imagemagick | imagemagick licen[cs]e | | imagemagick | imagemagick org script license
mulan | mulan | mulan(?: permissive software| psl)? licen[cs]e | 1.0 2.0 | mulanpsl | license coscl org cn mulanpsl
ntp | ntp | ntp licen[cs]e | | ntp | opensource org licen[cs]es? ntp
tcl | tcl | tcl(?: tk)? licen[cs]e | | tcl | tcl tk(?: software)? license terms
sgi | sgi | sgi free software licen[cs]e b | 1.0 1.1 2.0 | sgi b | oss sgi com projects freeb
motosoto | motosoto | motosoto open source licen[cs]e | | motosoto | opensource org licen[cs]es? motosoto
blueoak | blue oak | blue oak model licen[cs]e | 1.0 | blueoak | blueoakcouncil org license
parity | parity | parity public licen[cs]e | 6.0 7.0 | parity | paritylicense com
polyform | polyform | polyform (?:noncommercial|small business|shield|strict|internal use|perimeter) licen[cs]e | 1.0 | polyform noncommercial | polyformproject org licen[cs]es
openrail | openrail | (?:creativeml )?openrail(?: m)?(?: licen[cs]e)? | | openrail m | huggingface co(?: [^ ]{1,40}){0,4} openrail
llama | llama | llama 2 community licen[cs]e(?: agreement)? | | llama2 | ai meta com llama license
cc-by | attribution | (?:creative commons )?attribution | 1.0 2.0 2.5 3.0 4.0 | cc by | creativecommons org licen[cs]es by
cc-by-sa | attribution | (?:creative commons )?attribution share ?alike | 1.0 2.0 2.5 3.0 4.0 | cc by sa | creativecommons org licen[cs]es by sa
cc-by-nd | attribution | (?:creative commons )?attribution no ?deriv(?:ative)?s?(?: works)? | 1.0 2.0 2.5 3.0 4.0 | cc by nd | creativecommons org licen[cs]es by nd
cc-by-nc | attribution | (?:creative commons )?attribution non ?commercial | 1.0 2.0 2.5 3.0 4.0 | cc by nc | creativecommons org licen[cs]es by nc
cc-by-nc-sa | attribution | (?:creative commons )?attribution non ?commercial share ?alike | 1.0 2.0 2.5 3.0 4.0 | cc by nc sa | creativecommons org licen[cs]es by nc sa
cc-by-nc-nd | attribution | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? | 1.0 2.0 2.5 3.0 4.0 | cc by nc nd | creativecommons org licen[cs]es by nc nd
cc-by | cc by | cc by | 1.0 2.0 2.5 3.0 4.0 | cc by | cc by deed
cc-by-sa | cc by sa | cc by sa | 1.0 2.0 2.5 3.0 4.0 | cc by sa | cc by sa deed
cc-by-nd | cc by nd | cc by nd | 1.0 2.0 2.5 3.0 4.0 | cc by nd | cc by nd deed
cc-by-nc | cc by nc | cc by nc | 1.0 2.0 2.5 3.0 4.0 | cc by nc | cc by nc deed
cc-by-nc-sa | cc by nc sa | cc by nc sa | 1.0 2.0 2.5 3.0 4.0 | cc by nc sa | cc by nc sa deed
cc-by-nc-nd | cc by nc nd | cc by nc nd | 1.0 2.0 2.5 3.0 4.0 | cc by nc nd | cc by nc nd deed
cc0 | cc0 | cc0(?: universal)?(?: public domain dedication)? | 1.0 | cc0 | creativecommons org publicdomain zero
"""

# Sentences of public license texts. label | priority | keyword | pattern
SENTENCES = """
mit | TEXT | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | TEXT | furnished to do so | to whom the software is furnished to do so the software is provided as is
isc | TEXT | with or without fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
hpnd | TEXT | without fee is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
bsd | TEXT | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | TEXT | in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | TEXT | endorse or promote | neither the names? of(?: [^ ]{1,40}){1,14} nor the names of(?: its)? contributors may be used to endorse or promote
bsd-4-clause | TEXT | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0 | TEXT | apache license | licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license
apache-2.0 | TEXT | apache license | apache license version 2 0 january 2004
apache-1.1 | TEXT | apache software foundation | this product includes software developed by the apache software foundation
gpl-2.0 | TEXT | general public | gnu general public license version 2 june 1991
gpl-3.0 | TEXT | general public | gnu general public license version 3 29 june 2007
gpl-2.0 | TEXT | free software foundation | under the terms of the gnu general public license(?: version 2)? as published by the free software foundation(?: either)? version 2(?: of the license)?
gpl-3.0 | TEXT | free software foundation | under the terms of the gnu general public license(?: version 3)? as published by the free software foundation(?: either)? version 3(?: of the license)?
lgpl-2.1 | TEXT | free software foundation | under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation(?: either)? version 2 1(?: of the license)?
lgpl-3.0 | TEXT | free software foundation | under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3(?: of the license)?
agpl-3.0 | TEXT | free software foundation | under the terms of the gnu affero general public license as published by the free software foundation(?: either)? version 3(?: of the license)?
lgpl-2.1 | TEXT | general public | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | TEXT | general public | gnu lesser general public license version 3 29 june 2007
agpl-3.0 | TEXT | affero | gnu affero general public license version 3 19 november 2007
gfdl | TEXT | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | TEXT | mozilla | this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-1.1 | TEXT | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | TEXT | eclipse | made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2.0 | TEXT | eclipse | made available under the terms of the eclipse public license v(?:ersion)? ?2 0
cddl-1.0 | TEXT | common development | the contents of this file are subject to the terms of the common development and distribution license
zlib | TEXT | without any express or implied | this software is provided as is without any express or implied warranty in no event will the authors? be held liable
boost-1.0 | TEXT | boost | boost software license version 1 0 august 17th 2003
unlicense | TEXT | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | TEXT | do what the | do what the f[^ ]{2,6} you want to(?: public licen[cs]e)?
ofl-1.1 | TEXT | font software | this font software is licensed under the sil open font license version 1 1
artistic-1.0 | TEXT | package may be copied | the intent of this document is to state the conditions under which a package may be copied
cc0-1.0 | TEXT | neighboring rights | has waived all copyright and related or neighboring rights
beerware | TEXT | a beer | you think this stuff is worth it you can buy me a beer in return
vim | TEXT | charityware | vim is charityware
openssl | TEXT | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ncsa | TEXT | deal with the software | to deal with the software without restriction including without limitation the rights
ms-pl | TEXT | accompanying software | this license governs use of the accompanying software if you use the software you accept this license
postgresql | TEXT | without a written agreement | without fee and without a written agreement is hereby granted
json | TEXT | good not evil | the software shall be used for good not evil
commons-clause | TEXT | commons clause | commons clause license condition v?1 0
commons-clause | NAME | commons clause | commons clause
public-domain | GRANT | public domain | (?:placed|released|dedicated|is|are)(?: hereby)?(?: in| into| to)(?: the)? public domain
public-domain | URL | publicdomain | creativecommons org publicdomain mark 1 0
public-domain | NAME | public domain | public domain(?: mark| dedication| work)
creative-commons | NAME | creative commons | creative commons(?: public)? licen[cs]e
creative-commons | URL | creativecommons | creativecommons org licen[cs]es
open-source | HINT | open source | open source(?: initiative)? licen[cs]e
dual | HINT | dual licen | dual licen[cs]ed
proprietary | GRANT | confidential | confidential and proprietary(?: information)?
proprietary | GRANT | prior written | may not be (?:reproduced|copied|distributed|used)(?: [^ ]{1,40}){0,12} without(?: the)? prior written (?:permission|consent)
proprietary | NAME | all rights | all rights reserved
proprietary | NAME | proprietary | proprietary licen[cs]e
commercial | NAME | commercial licen | commercial licen[cs]e
freeware | HINT | freeware | freeware(?: licen[cs]e)?
shareware | HINT | shareware | shareware(?: licen[cs]e)?
eula | NAME | end user | end user licen[cs]e agreement
non-commercial | HINT | commercial use | (?:for )?non ?commercial use only
"""

GRANTED = (
    "(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed|shared|redistributed) (?:under|by|according to)"
    "|terms (?:and conditions )?of|sous(?: la)? licence|bajo(?: la)? licencia|unter(?: der| einer)? lizenz|lizenziert unter"
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str


def version_pattern(version: str) -> str:
    """``2.0`` as it stands in normalised text: an optional word, a dot as a space, a zero that may be left out."""
    major, minor = version.split(".")
    return f"(?: version| ver| v)? v?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")


def family_rules(label: str, keyword: str, name: str, versions: list[str], tag: str, url: str) -> list[Rule]:
    """Tag, address, grant and name of a family, with each version and without one."""
    at = re.match("[a-z0-9 ]+", url)[0]
    grant = f"(?:{GRANTED})(?: an?| the| terms of the| terms and conditions of the)? {name}"
    out = []
    for v in versions:
        full, number = f"{label}-{v}", version_pattern(v)
        out += [
            Rule(full, TAG, "spdx license identifier", f"spdx license identifier {tag}{number}(?: only| or later)?"),
            Rule(full, URL, at, f"{url}{number}"),
            Rule(full, GRANT, keyword, f"{grant}{number}(?: or (?:any )?later)?"),
            Rule(full, VERSIONED, keyword, f"{name}{number}"),
        ]
    plain = [Rule(label, TAG, "spdx license identifier", f"spdx license identifier {tag}"), Rule(label, URL, at, url), Rule(label, GRANT, keyword, grant)]
    # "attribution" alone is a word like any other; it counts with a version, a grant, a tag or an address.
    return [*out, *plain, *([] if keyword == "attribution" else [Rule(label, NAME, keyword, name)])]


def rows(table: str) -> list[list[str]]:
    """Cells between spaced bars; an empty cell is two bars with one space."""
    return [[cell.strip() for cell in re.split(r" \|(?= )", line)] for line in table.strip().splitlines()]


def all_rules() -> list[Rule]:
    """Sentences first, then families in the order of the table."""
    priorities = {"TEXT": TEXT, "URL": URL, "GRANT": GRANT, "NAME": NAME, "HINT": HINT}
    out = [Rule(label, priorities[p], keyword, pattern) for label, p, keyword, pattern in rows(SENTENCES)]
    for label, keyword, name, versions, tag, url in rows(FAMILIES):
        out += family_rules(label, keyword, name, versions.split(), tag, url)
    return out
