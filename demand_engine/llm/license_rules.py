"""Signature rules of operator 11, written over words: lower case, one blank between words, punctuation gone.

A rule is ``label | keyword | expression``. The keyword is a piece of text every match holds, so a text without it is not
searched. An expression matches whole words. Sections are in order of priority, rules within a section in the order written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Phrases whose every occurrence is reported, whatever else is found there.
BASE = """
mit | under the mit license | under the mit license
apache-2 | apache license version 2 | apache license version 2
cc-by-nc | cc by nc | cc by nc
"""

# Labels of SPDX identifiers; "spdx license identifier" and the identifier's words are the rule.
TAGS = """
0bsd: 0BSD
afl-3: AFL-3.0
agpl-1: AGPL-1.0-only AGPL-1.0-or-later AGPL-1.0
agpl-3: AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0
apache-1: Apache-1.0
apache-1.1: Apache-1.1
apache-2: Apache-2.0
apsl-2: APSL-2.0
artistic-1: Artistic-1.0 Artistic-1.0-Perl
artistic-2: Artistic-2.0
beerware: Beerware
blueoak-1: BlueOak-1.0.0
boost-1: BSL-1.0
bsd-1: BSD-1-Clause
bsd-2: BSD-2-Clause
bsd-3: BSD-3-Clause
bsd-4: BSD-4-Clause
busl-1.1: BUSL-1.1
cc-by-1: CC-BY-1.0
cc-by-2: CC-BY-2.0
cc-by-2.5: CC-BY-2.5
cc-by-3: CC-BY-3.0
cc-by-4: CC-BY-4.0
cc-by-nc-3: CC-BY-NC-3.0
cc-by-nc-4: CC-BY-NC-4.0
cc-by-nc-nd-4: CC-BY-NC-ND-4.0
cc-by-nc-sa-4: CC-BY-NC-SA-4.0
cc-by-nd-4: CC-BY-ND-4.0
cc-by-sa-3: CC-BY-SA-3.0
cc-by-sa-4: CC-BY-SA-4.0
cc0: CC0-1.0
cddl-1: CDDL-1.0
cddl-1.1: CDDL-1.1
cecill-2.1: CECILL-2.1
cecill-b: CECILL-B
cecill-c: CECILL-C
cpl-1: CPL-1.0
ecl-2: ECL-2.0
elastic-2: Elastic-2.0
epl-1: EPL-1.0
epl-2: EPL-2.0
eupl-1.1: EUPL-1.1
eupl-1.2: EUPL-1.2
gfdl-1.2: GFDL-1.2 GFDL-1.2-only GFDL-1.2-or-later
gfdl-1.3: GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later
gpl-1: GPL-1.0 GPL-1.0-only GPL-1.0-or-later
gpl-2: GPL-2.0 GPL-2.0-only GPL-2.0-or-later
gpl-3: GPL-3.0 GPL-3.0-only GPL-3.0-or-later
isc: ISC
lgpl-2: LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later
lgpl-2.1: LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later
lgpl-3: LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later
lppl-1.3c: LPPL-1.3c
mit: MIT
mit-0: MIT-0
mpl-1.1: MPL-1.1
mpl-2: MPL-2.0
ms-pl: MS-PL
ms-rl: MS-RL
mulan-2: MulanPSL-2.0
ncsa: NCSA
odbl-1: ODbL-1.0
odc-by-1: ODC-By-1.0
ofl-1.1: OFL-1.1
openssl: OpenSSL
osl-3: OSL-3.0
pddl-1: PDDL-1.0
php-3: PHP-3.01 PHP-3.0
postgresql: PostgreSQL
psf-2: PSF-2.0 Python-2.0
ruby: Ruby
sspl-1: SSPL-1.0
unicode: Unicode-3.0 Unicode-DFS-2016
unlicense: Unlicense
upl-1: UPL-1.0
vim: Vim
w3c: W3C
wtfpl: WTFPL
x11: X11
zlib: Zlib
zpl-2.1: ZPL-2.1
"""

# Full names with a version, and notices that name one.
NAMES = r"""
agpl-3 | affero | gnu affero general public licen[cs]e (?:as published by the free software foundation (?:either )?)?(?:version |v ?)?3(?: 0)?
agpl-1 | affero | (?:gnu )?affero general public licen[cs]e (?:version |v ?)?1(?: 0)?
lgpl-3 | lesser general | gnu lesser general public licen[cs]e (?:as published by the free software foundation (?:either )?)?(?:version |v ?)?3(?: 0)?
lgpl-2.1 | lesser general | gnu lesser general public licen[cs]e (?:as published by the free software foundation (?:either )?)?(?:version |v ?)?2 1
lgpl-2 | library general | gnu library general public licen[cs]e (?:as published by the free software foundation (?:either )?)?(?:version |v ?)?2(?: 0)?
gpl-3 | general public | gnu general public licen[cs]e (?:as published by the free software foundation (?:either )?)?(?:version |v ?)?3(?: 0)?
gpl-2 | general public | gnu general public licen[cs]e (?:as published by the free software foundation (?:either )?)?(?:version |v ?)?2(?: 0)?
gpl-1 | general public | gnu general public licen[cs]e (?:as published by the free software foundation (?:either )?)?(?:version |v ?)?1(?: 0)?
gpl-3 | gpl | gpl ?(?:version |v ?)3(?: 0)?
gpl-2 | gpl | gpl ?(?:version |v ?)2(?: 0)?
gpl-3 | gpl | gplv3(?: 0)?
gpl-2 | gpl | gplv2(?: 0)?
lgpl-3 | lgpl | lgpl ?(?:version |v ?)?3(?: 0)?
lgpl-2.1 | lgpl | lgpl ?(?:version |v ?)?2 1
agpl-3 | agpl | agpl ?(?:version |v ?)?3(?: 0)?
apache-2 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?2(?: 0)?
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 1
apache-1 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 0
artistic-2 | artistic | artistic licen[cs]e (?:version |v ?)?2(?: 0)?
artistic-1 | artistic | artistic licen[cs]e (?:version |v ?)?1(?: 0)?
blueoak-1 | blue oak | blue oak model licen[cs]e(?: 1 0 0)?
boost-1 | boost software | boost software licen[cs]e(?: (?:version )?1 0)?
bsd-1 | bsd | (?:bsd 1 clause|1 clause bsd|one clause bsd)(?: licen[cs]e)?
bsd-2 | bsd | (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)(?: licen[cs]e)
bsd-3 | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)
bsd-4 | bsd | (?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?
0bsd | bsd | (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?
busl-1.1 | business source | business source licen[cs]e(?: (?:version )?1 1)?
cc-by-nc-nd-4 | noncommercial | (?:creative commons )?attribution noncommercial noderivatives 4 0(?: international)?
cc-by-nc-sa-4 | noncommercial | (?:creative commons )?attribution noncommercial sharealike 4 0(?: international)?
cc-by-nc-4 | noncommercial | (?:creative commons )?attribution noncommercial 4 0(?: international)?
cc-by-nc-nd-4 | non commercial | (?:creative commons )?attribution non commercial no derivatives 4 0(?: international)?
cc-by-nc-sa-4 | non commercial | (?:creative commons )?attribution non commercial share alike 4 0(?: international)?
cc-by-nc-4 | non commercial | (?:creative commons )?attribution non commercial 4 0(?: international)?
cc-by-nd-4 | noderivatives | (?:creative commons )?attribution noderivatives 4 0(?: international)?
cc-by-sa-4 | sharealike | (?:creative commons )?attribution sharealike 4 0(?: international)?
cc-by-sa-3 | sharealike | (?:creative commons )?attribution sharealike 3 0(?: unported)?
cc-by-sa-2.5 | sharealike | (?:creative commons )?attribution sharealike 2 5(?: generic)?
cc-by-4 | attribution 4 | (?:creative commons )?attribution 4 0(?: international)?
cc-by-3 | attribution 3 | (?:creative commons )?attribution 3 0(?: unported)?
cc-by-2.5 | attribution 2 | (?:creative commons )?attribution 2 5(?: generic)?
cc-by-2 | attribution 2 | (?:creative commons )?attribution 2 0(?: generic)?
cc-by-nc-nd-4 | cc by | cc by nc nd 4(?: 0)?
cc-by-nc-nd-3 | cc by | cc by nc nd 3(?: 0)?
cc-by-nc-sa-4 | cc by | cc by nc sa 4(?: 0)?
cc-by-nc-sa-3 | cc by | cc by nc sa 3(?: 0)?
cc-by-nc-4 | cc by | cc by nc 4(?: 0)?
cc-by-nc-3 | cc by | cc by nc 3(?: 0)?
cc-by-nc-2 | cc by | cc by nc 2(?: [05])?
cc-by-nd-4 | cc by | cc by nd 4(?: 0)?
cc-by-nd-3 | cc by | cc by nd 3(?: 0)?
cc-by-sa-4 | cc by | cc by sa 4(?: 0)?
cc-by-sa-3 | cc by | cc by sa 3(?: 0)?
cc-by-sa-2 | cc by | cc by sa 2(?: [05])?
cc-by-4 | cc by | cc by 4(?: 0)?
cc-by-3 | cc by | cc by 3(?: 0)?
cc-by-2 | cc by | cc by 2(?: [05])?
cc0 | cc0 | cc0 1 0(?: universal)?
cc0 | creative commons zero | creative commons zero(?: v?1 0)?(?: universal)?
cddl-1.1 | common development | common development and distribution licen[cs]e (?:version )?1 1
cddl-1 | common development | common development and distribution licen[cs]e(?: (?:version )?1 0)?
cecill-2.1 | cecill | cecill (?:free software licen[cs]e agreement )?(?:version )?2 1
cpl-1 | common public | common public licen[cs]e(?: (?:version )?1 0)?
ecl-2 | educational community | educational community licen[cs]e (?:version )?2 0
elastic-2 | elastic licen | elastic licen[cs]e (?:version )?2(?: 0)?
epl-2 | eclipse public | eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
epl-1 | eclipse public | eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
eupl-1.2 | european union public | european union public licen[cs]e (?:version |v ?)?1 2
eupl-1.1 | european union public | european union public licen[cs]e (?:version |v ?)?1 1
gfdl-1.3 | free documentation | gnu free documentation licen[cs]e (?:version )?1 3
gfdl-1.2 | free documentation | gnu free documentation licen[cs]e (?:version )?1 2
gfdl-1.1 | free documentation | gnu free documentation licen[cs]e (?:version )?1 1
lppl-1.3c | latex project | latex project public licen[cs]e(?: (?:version )?1 3c?)?
llama-2 | llama 2 | llama 2 community licen[cs]e(?: agreement)?
llama-3 | llama 3 | llama 3(?: \d)? community licen[cs]e(?: agreement)?
mpl-2 | mozilla public | mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
mpl-1.1 | mozilla public | mozilla public licen[cs]e (?:version |v ?)?1 1
mpl-1 | mozilla public | mozilla public licen[cs]e (?:version |v ?)?1 0
mulan-2 | mulan | mulan (?:psl|permissive software licen[cs]e) (?:version |v ?)?2
odbl-1 | open database | (?:odc )?open database licen[cs]e(?: (?:odbl )?(?:v ?)?1 0)?
odc-by-1 | open data commons | open data commons attribution licen[cs]e(?: 1 0)?
pddl-1 | public domain dedication | open data commons public domain dedication and licen[cs]e(?: pddl)?
ofl-1.1 | open font | (?:sil )?open font licen[cs]e(?: (?:version )?1 1)?
openrail-m | openrail | (?:bigcode |creativeml )?openrail m(?: v?\d)?(?: licen[cs]e)?
bigscience-rail-1 | bigscience | bigscience (?:bloom )?rail (?:licen[cs]e )?(?:v ?)?1 0
osl-3 | open software licen | open software licen[cs]e (?:version |v ?)?3 0
afl-3 | academic free | academic free licen[cs]e (?:version |v ?)?3 0
afl-2.1 | academic free | academic free licen[cs]e (?:version |v ?)?2 1
apsl-2 | apple public | apple public source licen[cs]e(?: (?:version )?2 0)?
php-3 | php licen | php licen[cs]e (?:version )?3 0?1?
psf-2 | python software foundation | python software foundation licen[cs]e(?: agreement)?(?: (?:version )?2)?
polyform-nc-1 | polyform | polyform noncommercial licen[cs]e(?: 1 0 0)?
polyform-sb-1 | polyform | polyform small business licen[cs]e(?: 1 0 0)?
sspl-1 | server side public | server side public licen[cs]e(?: (?:version |v ?)?1)?
upl-1 | universal permissive | universal permissive licen[cs]e(?: (?:version |v ?)?1 0)?
zpl-2.1 | zope public | zope public licen[cs]e(?: (?:version )?2 1)?
zpl-2 | zope public | zope public licen[cs]e (?:version )?2 0
ms-pl | microsoft public | microsoft public licen[cs]e(?: ms pl)?
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e(?: ms rl)?
ncsa | university of illinois | university of illinois ncsa open source licen[cs]e
qpl-1 | q public | q public licen[cs]e(?: (?:version )?1 0)?
w3c | w3c software | w3c software(?: and document)?(?: notice and)? licen[cs]e
rpl-1.5 | reciprocal public | reciprocal public licen[cs]e(?: 1 5)?
"""

# Addresses of license texts.
PLACES = r"""
apache-2 | apache org licenses | (?:www )?apache org licenses license 2 0
apache-1.1 | apache org licenses | (?:www )?apache org licenses license 1 1
mit | opensource org | (?:www )?opensource org licenses mit(?: license(?: php)?)?
bsd-2 | opensource org | (?:www )?opensource org licenses bsd 2 clause
bsd-3 | opensource org | (?:www )?opensource org licenses bsd 3 clause
isc | opensource org | (?:www )?opensource org licenses isc(?: license)?
artistic-2 | opensource org | (?:www )?opensource org licenses artistic(?: license)? 2 0
epl-1 | eclipse org | (?:www )?eclipse org legal epl v10
epl-2 | eclipse org | (?:www )?eclipse org legal epl (?:v20|2 0)
edl-1 | eclipse org | (?:www )?eclipse org org documents edl v10
mpl-2 | mozilla org | (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-1.1 | mozilla org | (?:www )?mozilla org mpl mpl 1 1
gpl-3 | gnu org licenses | (?:www )?gnu org licenses gpl 3 0
gpl-2 | gnu org licenses | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0
lgpl-3 | gnu org licenses | (?:www )?gnu org licenses lgpl 3 0
lgpl-2.1 | gnu org licenses | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1
agpl-3 | gnu org licenses | (?:www )?gnu org licenses agpl 3 0
gfdl-1.3 | gnu org licenses | (?:www )?gnu org licenses fdl 1 3
gpl | gnu org licenses | (?:www )?gnu org licenses gpl
cc-by-nc-nd-4 | creativecommons org | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-4 | creativecommons org | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3 | creativecommons org | creativecommons org licenses by nc sa 3 0
cc-by-nc-4 | creativecommons org | creativecommons org licenses by nc 4 0
cc-by-nc-3 | creativecommons org | creativecommons org licenses by nc 3 0
cc-by-nd-4 | creativecommons org | creativecommons org licenses by nd 4 0
cc-by-sa-4 | creativecommons org | creativecommons org licenses by sa 4 0
cc-by-sa-3 | creativecommons org | creativecommons org licenses by sa 3 0
cc-by-4 | creativecommons org | creativecommons org licenses by 4 0
cc-by-3 | creativecommons org | creativecommons org licenses by 3 0
cc0 | creativecommons org | creativecommons org publicdomain zero 1 0
public-domain | creativecommons org | creativecommons org publicdomain mark 1 0
boost-1 | boost org | (?:www )?boost org license 1 0
unlicense | unlicense org | unlicense org
wtfpl | wtfpl net | (?:www )?wtfpl net
ofl-1.1 | sil org ofl | scripts sil org ofl
odbl-1 | opendatacommons org | (?:www )?opendatacommons org licenses odbl
odc-by-1 | opendatacommons org | (?:www )?opendatacommons org licenses by
zlib | zlib net | (?:www )?zlib net zlib license
cecill-2.1 | cecill info | (?:www )?cecill info licences licence cecill v2 1
php-3 | php net license | (?:www )?php net license 3 0?1?
sspl-1 | mongodb com | (?:www )?mongodb com licensing server side public license
elastic-2 | elastic co | (?:www )?elastic co licensing elastic license
busl-1.1 | mariadb com | (?:www )?mariadb com bsl11
"""

# Sentences of the license texts themselves.
TEXTS = r"""
mit | obtaining a copy | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
isc | purpose with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | purpose with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-2 | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3 | endorse or promote | neither the name of (?:\S+ ){1,20}nor the names of its contributors may be used to endorse or promote products
bsd-4 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
apache-2 | licensed under the apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | limitations under the license | see the license for the specific language governing permissions and limitations under the license
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
gpl | free software foundation | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-2 | later version | either version 2 of the license or at your option any later version
gpl-3 | later version | either version 3 of the license or at your option any later version
lgpl | lesser general | you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl | affero | you can redistribute it and or modify it under the terms of the gnu affero general public license
mpl-2 | mozilla public | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla public | the contents of this file are subject to the mozilla public license version 1 1
epl-1 | accompanying program | the accompanying program is provided under the terms of this eclipse public license
cddl-1 | common development | the contents of this file are subject to the terms of the common development and distribution license
zlib | redistribute it freely | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib | origin of this software | the origin of this software must not be misrepresented
libpng | png reference | the png reference library is supplied as is
boost-1 | accompanying documentation | obtaining a copy of the software and accompanying documentation covered by this license
unlicense | released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | what the | do what the f\S* you want to public license
beerware | beer | you can buy me a beer in return
cc0 | affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0 | waived all copyright | waived all copyright and related or neighboring rights
cc-by | appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-nc | commercial purposes | you may not use the material for commercial purposes
cc-by-nd | modified material | if you remix transform or build upon the material you may not distribute the modified material
cc-by-sa | contributions under | you must distribute your contributions under the same license as the original
ofl-1.1 | reserved font name | no modified version of the font software may use the reserved font name
artistic-1 | under which a package | the intent of this document is to state the conditions under which a package may be copied
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic software | this product includes cryptographic software written by eric young
postgresql | without a written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
ncsa | deal with the software | to deal with the software without restriction
json | good not evil | the software shall be used for good not evil
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
ntp | with or without fee | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee
php-3 | php | this product includes php software
psf-2 | psf | psf hereby grants licensee a nonexclusive royalty free world wide license
vim | vim | there are no restrictions on distributing unmodified copies of vim
elastic-2 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | right to sell | the license does not include and the license does not grant to you the right to sell the software
busl-1.1 | production use | use of the licensed work (?:\S+ ){0,12}production use
sspl-1 | service source code | you must make the service source code available via network download
gfdl | invariant sections | with no invariant sections no front cover texts and no back cover texts
odbl-1 | derivative database | you must keep open all (?:public )?notices (?:\S+ ){0,8}derivative database
unicode | data files | permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode )?data files and any associated documentation
sleepycat | redistributions in any form | redistributions in any form must be accompanied by information on how to obtain complete source code
public-domain | public domain | (?:this (?:work|file|code|software|text|page) (?:is|has been) (?:hereby )?)?(?:placed |released |dedicated )?(?:in|into|to) the public domain
proprietary | all rights reserved | copyright (?:c )?(?:\d{4} )?(?:\S+ ){0,8}all rights reserved
proprietary | prior written | may not be (?:reproduced|copied|distributed) (?:\S+ ){0,12}without (?:the )?(?:express )?prior written (?:permission|consent)
proprietary | confidential | proprietary and confidential
proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
no-training | not be used | (?:may|must) not be used (?:\S+ ){0,6}(?:train|training) (?:\S+ ){0,4}(?:models?|ai|intelligence)
"""

# Names without a version, and abbreviations.
MENTIONS = r"""
mit | mit licen | (?:the )?mit licen[cs]e
mit | expat | expat licen[cs]e
mit-0 | mit no attribution | mit no attribution(?: licen[cs]e)?
apache | apache licen | apache licen[cs]e
apache | apache software licen | apache software licen[cs]e
agpl | affero general | (?:gnu )?affero general public licen[cs]e
lgpl | lesser general | (?:gnu )?lesser general public licen[cs]e
lgpl | library general | (?:gnu )?library general public licen[cs]e
gpl | general public licen | (?:gnu )?general public licen[cs]e
gpl | gnu gpl | gnu gpl
gfdl | free documentation | (?:gnu )?free documentation licen[cs]e
bsd | bsd | bsd (?:style )?licen[cs]e
isc | isc licen | isc licen[cs]e
mpl | mozilla public | mozilla public licen[cs]e
epl | eclipse public | eclipse public licen[cs]e
edl-1 | eclipse distribution | eclipse distribution licen[cs]e
eupl | european union public | european union public licen[cs]e
artistic | artistic licen | artistic licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng licen | libpng licen[cs]e
unlicense | the unlicense | the unlicense
wtfpl | wtfpl | wtfpl
beerware | beerware | beerware(?: licen[cs]e)?
cecill | cecill | cecill(?: [bc])?(?: licen[cs]e)?
vim | vim licen | vim licen[cs]e
ruby | ruby licen | ruby licen[cs]e
php | php licen | php licen[cs]e
perl | the same terms as perl | (?:under )?the same terms as perl(?: \d)? itself
psf | python licen | python licen[cs]e
openssl | openssl licen | openssl licen[cs]e
postgresql | postgresql licen | postgresql licen[cs]e
unicode | unicode licen | unicode licen[cs]e(?: agreement)?
sleepycat | sleepycat | sleepycat licen[cs]e
x11 | x11 licen | x11 licen[cs]e
json | json licen | json licen[cs]e
intel | intel open source | intel open source licen[cs]e
ibm-public | ibm public | ibm public licen[cs]e
sun-public | sun public | sun public licen[cs]e
nokia | nokia open source | nokia open source licen[cs]e
lucent | lucent public | lucent public licen[cs]e
ms-pl | ms pl | ms pl
commons-clause | commons clause | commons clause(?: licen[cs]e)?
elastic | elastic licen | elastic licen[cs]e
llama | community licen | llama community licen[cs]e
gemma | gemma | gemma terms of use
openrail | openrail | openrail(?: licen[cs]e)?
hippocratic | hippocratic | hippocratic licen[cs]e
cc-by-nc-nd | by nc nd | cc by nc nd
cc-by-nc-sa | by nc sa | cc by nc sa
cc-by-nd | by nd | cc by nd
cc-by-sa | by sa | cc by sa
cc-by | cc by | cc by
cc0 | cc0 | cc0
cc-by-nc | creative commons attribution | creative commons attribution non ?commercial
cc-by-sa | alike | creative commons attribution share ?alike
cc-by | creative commons attribution | creative commons attribution
cc | creative commons | creative commons(?: licen[cs]e)?
open-source | open source licen | (?:an )?open source licen[cs]e
proprietary | all rights reserved | all rights reserved
proprietary | proprietary licen | proprietary licen[cs]e
dual | dual licen | dual licen[cs]ed
"""

WEIGHTS = {"base": 0.9, "tag": 0.99, "name": 0.9, "place": 0.8, "text": 0.7, "mention": 0.4}  # how sure a kind of rule is


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keyword: str
    pattern: str

    def compiled(self) -> re.Pattern[str]:
        return re.compile(f"(?<![^ ])(?:{self.pattern})(?![^ ])")


def section(kind: str, table: str) -> list[Rule]:
    return [Rule(label, kind, keyword, pattern) for label, keyword, pattern in (line.split(" | ") for line in table.strip().splitlines())]


def tags() -> list[Rule]:
    """The longest identifiers first, so that ``GPL-2.0-or-later`` is not read as ``GPL-2.0``."""
    found = [(label, re.sub("[^a-z0-9]+", " ", name.lower())) for line in TAGS.strip().splitlines()
             for label, names in [line.split(": ")] for name in names.split()]
    return [Rule(label, "tag", "spdx license identifier", f"spdx license identifier {words}") for label, words in sorted(found, key=lambda x: (-len(x[1]), x))]


def all_rules() -> list[Rule]:
    return section("base", BASE) + tags() + section("name", NAMES) + section("place", PLACES) + section("text", TEXTS) + section("mention", MENTIONS)
