"""Signatures of licenses, written by hand from the wordings of notices, headers, badges and package files.

A line is ``label; priority; keywords; confidence; expression``. Expressions run over lower-cased words joined by single
spaces. Keywords are what every match holds, joined by + where it holds several; _ stands for a space, so that a keyword
with one at both ends is a whole word. In expressions LIC is license or licence, THE an optional "the", OF what may stand before a
name after "under", VER an optional "version" before a number, and GRANT the verbs of a grant and "under".
"""

from __future__ import annotations

FRAGMENTS = {
    "GRANT": r"(?:(?:dual |re|also |is |are |hereby )?licen[cs]ed|released|distributed|redistributed|available|provided|published|covered|offered|shared|issued|made available|protected) (?:only )?under (?:OF)?",
    "OF": r"(?:the |a |an )?(?:terms (?:and conditions )?of (?:the )?|conditions of (?:the )?)?",
    "VER": r"(?: LIC)?(?: version| ver| v)?",
    "LIC": r"licen[cs]e",
    "THE": r"(?:the )?",
}

#: Sentences of license texts and of the standard headers of source files.
TEXTS = r"""
mit; 92; hereby granted+person obtaining; 0.97; permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
mit; 72; notice shall be included in all copies; 0.8; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit; 60; authors or copyright holders be liable; 0.6; in no event shall the authors or copyright holders be liable for any claim damages or other liability
x11; 80; consortium; 0.85; except as contained in this notice the name of the x consortium shall not be used in advertising
mit-0; 78; substantial portions; 0.7; without including the copyright notice in (?:all )?copies or substantial portions
isc; 92; permission to use copy modify and; 0.97; permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc; 70; disclaims all warranties with regard; 0.6; the author disclaims all warranties with regard to this software
hpnd; 84; permission to use copy modify and distribute this software and its documentation; 0.9; permission to use copy modify and distribute this software and its documentation for any purpose
zlib; 90; express or implied warranty+in no event will the authors; 0.95; this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib; 88; plainly marked; 0.9; altered source versions must be plainly marked as such
zlib; 86; must not be misrepresented; 0.9; the origin of this software must not be misrepresented
bsd; 80; redistribution and use in source and binary forms; 0.9; redistribution and use in source and binary forms with or without modification(?: are permitted)?(?: provided that the following conditions are met)?
bsd; 58; redistributions of source code must retain; 0.8; redistributions of source code must retain the above copyright notice
bsd; 57; redistributions in binary form must reproduce; 0.8; redistributions in binary form must reproduce the above copyright notice
bsd-3; 88; endorse or promote products; 0.9; neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-4; 89; mentioning features or use; 0.95; all advertising materials mentioning features or use of this software must display
bsd; 55; this software is provided by the; 0.7; this software is provided by the (?:copyright holders? and contributors|author|regents and contributors) as is and any express or implied warranties
bsd-0; 91; permission to use copy modify and+fee is hereby granted; 0.9; 0bsd permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
apache-2; 93; you may not use this file except in compliance; 0.97; licensed under the apache LIC version 2 0 the LIC you may not use this file except in compliance with the LIC
apache-2; 76; you may not use this file except in compliance; 0.75; you may not use this file except in compliance with the LIC
apache-2; 74; apache org licenses; 0.95; you may obtain a copy of the LIC at https? www apache org licenses license 2 0
apache-2; 68; unless required by applicable law; 0.7; unless required by applicable law or agreed to in writing software distributed under the LIC is distributed on an as is basis
apache-2; 80; grants to you a perpetual worldwide; 0.9; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) LIC
apache-1.1; 84; developed by the apache software foundation; 0.9; this product includes software developed by the apache software foundation
gpl; 82; free software foundation+redistribute it and or modify; 0.9; (?:is free software )?you can redistribute it and or modify it under the terms of the gnu general public LIC as published by the free software foundation
gpl-2-or-later; 94; either version 2 of the licen; 0.95; redistribute it and or modify it under the terms of the gnu general public LIC as published by the free software foundation either version 2 of the LIC or (?:at your option )?any later version
gpl-3-or-later; 94; either version 3 of the licen; 0.95; redistribute it and or modify it under the terms of the gnu general public LIC as published by the free software foundation either version 3 of the LIC or (?:at your option )?any later version
gpl-2; 93; redistribute it and or modify it under; 0.9; redistribute it and or modify it under the terms of (?:version 2 of the gnu general public LIC|the gnu general public LIC as published by the free software foundation (?:only )?version 2 of the LIC)
lgpl; 83; lesser general public+free software foundation; 0.9; redistribute it and or modify it under the terms of the gnu lesser general public LIC as published by the free software foundation
lgpl-2.1-or-later; 95; either version 2 1 of the licen; 0.95; under the terms of the gnu lesser general public LIC as published by the free software foundation either version 2 1 of the LIC or (?:at your option )?any later version
lgpl-3-or-later; 95; lesser+either version 3 of the licen; 0.95; under the terms of the gnu lesser general public LIC as published by the free software foundation either version 3 of the LIC or (?:at your option )?any later version
lgpl-2; 90; gnu library general public; 0.9; gnu library general public LIC(?: version 2)?
agpl; 84; affero general public+free software foundation; 0.9; redistribute it and or modify it under the terms of the gnu affero general public LIC as published by the free software foundation
agpl-3-or-later; 95; affero+either version 3 of the licen; 0.95; under the terms of the gnu affero general public LIC as published by the free software foundation either version 3 of the LIC or (?:at your option )?any later version
gpl; 56; hope that it will be useful; 0.6; distributed in the hope that it will be useful but without any warranty
gpl; 54; received a copy of the gnu general public; 0.7; you should have received a copy of the gnu general public LIC along with this (?:program|library|file|software|package)
lgpl; 64; received a copy of the gnu lesser; 0.75; you should have received a copy of the gnu lesser general public LIC
agpl; 64; received a copy of the gnu affero; 0.75; you should have received a copy of the gnu affero general public LIC
gpl-exception; 70; as a special exception; 0.6; as a special exception (?:to the gnu general public LIC|you may|the copyright holders?)
gfdl; 90; gnu free documentation+permission is granted to copy; 0.95; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation LIC
gfdl; 78; no invariant sections; 0.85; with no invariant sections no front cover texts and no back cover texts
mpl-2; 92; mozilla public+source code form is subject; 0.97; this source code form is subject to the terms of the mozilla public LIC v 2 0
mpl-2; 72; mozilla org mpl; 0.9; you can obtain one at https? (?:www )?mozilla org mpl 2 0
mpl-1.1; 90; mozilla public+contents of this file are subject; 0.95; the contents of this file are subject to the mozilla public LIC version 1 1
mpl-1.0; 90; mozilla public+contents of this file are subject; 0.95; the contents of this file are subject to the mozilla public LIC version 1 0
npl; 88; netscape public; 0.9; contents of this file are subject to the netscape public LIC
epl-1; 90; eclipse public+accompanying materials; 0.95; this program and the accompanying materials are made available under the terms of the eclipse public LIC (?:version |v ?)?1 0
epl-2; 90; eclipse public+accompanying materials; 0.95; this program and the accompanying materials are made available under the terms of the eclipse public LIC (?:version |v ?)?2 0
cpl-1; 88; common public; 0.9; made available under the terms of the common public LIC(?: (?:version |v ?)?1 0)?
cddl; 90; common development and distribution; 0.95; the contents of this file are subject to the terms of the common development and distribution LIC
apsl; 85; apple public source; 0.9; subject to the apple public source LIC(?: version [12] [0-9])?
boost; 92; boost software licen; 0.97; distributed under the boost software LIC version 1 0
boost; 78; license_1_0; 0.9; see accompanying file license 1 0 txt
unlicense; 92; free and unencumbered; 0.97; this is free and unencumbered software released in(?: |)to the public domain
unlicense; 84; anyone is free to copy modify; 0.9; anyone is free to copy modify publish use compile sell or distribute this software
wtfpl; 92; do what the fuck; 0.95; do what the fuck you want to(?: public LIC)?
beerware; 88; beer; 0.9; (?:you can|can) buy me a beer in return
beerware; 90; beer_ware; 0.95; the beer ware LIC(?: revision [0-9]+)?
artistic-2; 84; artistic; 0.9; this (?:program|library|package|software) is free software you can redistribute it and or modify it under the terms of the artistic LIC version 2 0
perl; 86; perl; 0.9; (?:you can|may) redistribute it and or modify it under the same terms as perl(?: [0-9]+)?(?: itself)?
python; 80; making python available; 0.85; psf is making python available to licensee on an as is basis
python; 79; python software foundation; 0.85; python software foundation LIC version [0-9]+
ofl; 90; font software+hereby granted; 0.95; permission is hereby granted free of charge to any person obtaining a copy of the font software
ofl; 92; sil open font; 0.95; this font software is licensed under the sil open font LIC version 1 1
openssl; 84; openssl project; 0.9; this product includes software developed by the openssl project
curl; 80; permission to use copy modify and distribute this software+any purpose; 0.75; curl copyright and permission notice permission to use copy modify and distribute this software for any purpose
ncsa; 84; illinois+open source; 0.9; university of illinois (?:ncsa )?open source LIC
postgresql; 84; permission to use copy modify and distribute this software and its documentation+written agreement; 0.9; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
cc0; 90; extent possible under law; 0.9; to the extent possible under law (?:[^ ]+ ){1,8}has waived all copyright
cc0; 82; dedicated the work to the public domain; 0.85; dedicated the work to the public domain by waiving all (?:of )?(?:his or her |their )?rights
cc0; 81; has dedicated; 0.85; no copyright the person who associated a work with this deed has dedicated
odbl; 86; open database licen; 0.9; (?:this [^ ]+ |is )?made available under the open database LIC
elastic; 86; elastic licen; 0.9; you may not provide the software to third parties as a hosted or managed service under the elastic LIC|(?:licensed|available) under the elastic LIC(?: 2 0)?
bsl; 86; business source; 0.9; business source LIC(?: 1 1)?
sspl; 86; server side public; 0.9; server side public LIC(?: v?(?:ersion )?1)?
commons-clause; 86; commons clause; 0.9; commons clause (?:LIC )?condition v?1 0|with commons clause
llama; 84; llama; 0.85; llama [0-9](?: [0-9])? (?:is licensed under the llama [0-9](?: [0-9])? )?community LIC(?: agreement)?
openrail; 84; rail; 0.8; (?:creativeml |bigscience )?open ?rail ?(?:m|s)?(?: LIC)?
ms-pl; 82; microsoft public; 0.9; microsoft public LIC(?: ms pl)?
ms-rl; 82; microsoft reciprocal; 0.9; microsoft reciprocal LIC(?: ms rl)?
json; 80; be used for good; 0.9; the software shall be used for good not evil
ijg; 78; independent jpeg group; 0.85; based in part on the work of the independent jpeg group
libpng; 78; libpng; 0.8; libpng LIC(?: version 2)?|this code is released under the libpng LIC
freetype; 78; freetype; 0.8; freetype project LIC|the freetype LIC
imagemagick; 76; imagemagick; 0.8; imagemagick LIC
unicode; 78; unicode inc; 0.85; copyright (?:c )?[0-9]{4} [0-9]{4} unicode inc all rights reserved distributed under the terms of use
w3c; 78; w3c; 0.85; w3c (?:software (?:notice )?(?:and document )?|document )LIC
"""

#: Grants and references that name a license.
NAMES = r"""
mit; 59; under+mit_; 0.95; GRANTmit(?: x11| expat)?(?: LIC)?
mit; 58; mit+licen; 0.9; under (?:OF)?mit(?: x11| expat| style)? LIC
mit; 56; mit+licen; 0.8; (?:governed by|subject to|see|read|uses?) OFmit LIC
mit; 50; mit+licen; 0.7; mit LIC(?:d)?
mit; 52; expat+licen; 0.8; expat LIC
mit-0; 66; mit; 0.9; mit (?:0|no attribution|zero)(?: LIC)?
x11; 55; x11 licen; 0.8; THEx11 LIC
isc; 58; isc; 0.9; GRANTisc(?: LIC)?
isc; 50; isc licen; 0.7; isc LIC
apache-2; 69; apache; 0.95; GRANTapache(?: software)?VER 2(?: 0)?(?: LIC)?
apache-2; 67; apache+2; 0.9; apache(?: software)? LIC(?: version| v)? ?2(?: 0)?
apache-2; 66; apache+2; 0.85; apache v?2(?: 0)? LIC
apache-1; 66; apache+1; 0.85; apache(?: software)? LIC(?: version| v)? 1 [01]
apache; 52; apache; 0.8; GRANTapache(?: software)?(?: LIC)?
apache; 48; apache+licen; 0.7; apache(?: software)? LIC(?:d)?
asl-2; 58; asl; 0.7; asl (?:v|version )?2(?: 0)?
gpl-2; 67; gpl; 0.95; GRANT(?:gnu )?gpl ?(?:version |v )?v?2(?: 0)?(?: LIC)?
gpl-3; 67; gpl; 0.95; GRANT(?:gnu )?gpl ?(?:version |v )?v?3(?: 0)?(?: LIC)?
gpl; 60; gpl; 0.85; GRANT(?:gnu )?gpl(?: LIC)?
gpl-2; 69; general public; 0.95; GRANTgnu general publicVER ?v?2(?: 0)?
gpl-3; 69; general public; 0.95; GRANTgnu general publicVER ?v?3(?: 0)?
gpl; 61; general public; 0.85; GRANTgnu general public(?: LIC)?
gpl-2; 64; general public+2; 0.9; gnu general public LIC(?: version| v)? ?v?2(?: 0)?
gpl-3; 64; general public+3; 0.9; gnu general public LIC(?: version| v)? ?v?3(?: 0)?
gpl-1; 63; general public+1; 0.85; gnu general public LIC(?: version| v)? 1(?: 0)?
gpl; 49; general public; 0.7; gnu general public LIC
gpl-2; 62; gplv2; 0.8; (?:gnu )?gplv2(?: only| or later| \+)?
gpl-3; 62; gplv3; 0.8; (?:gnu )?gplv3(?: only| or later| \+)?
gpl; 45; gpl; 0.7; (?:gnu )?gpl LIC(?:d)?
lgpl-2.1; 71; lesser; 0.95; gnu lesser general public LIC(?: version| v)? ?v?2 1
lgpl-3; 71; lesser; 0.95; gnu lesser general public LIC(?: version| v)? ?v?3(?: 0)?
lgpl; 63; lesser general public; 0.85; (?:GRANT)?gnu lesser general public(?: LIC)?
lgpl-2.1; 70; lgpl; 0.9; GRANT(?:gnu )?lgpl ?(?:version |v )?v?2 1
lgpl-3; 70; lgpl; 0.9; GRANT(?:gnu )?lgpl ?(?:version |v )?v?3(?: 0)?
lgpl; 62; lgpl; 0.85; GRANT(?:gnu )?lgpl(?: LIC)?
lgpl; 50; lgpl; 0.65; lgplv?(?: ?[23](?: [01])?)?(?: LIC)?
agpl-3; 71; affero; 0.95; gnu affero general public LIC(?: version| v)? ?v?3(?: 0)?
agpl; 63; affero general public; 0.85; (?:GRANT)?gnu affero general public(?: LIC)?
agpl-3; 70; agpl; 0.9; GRANT(?:gnu )?agpl ?(?:version |v )?v?3(?: 0)?
agpl-3; 64; agplv3; 0.85; (?:gnu )?agplv3(?: only| or later)?
agpl; 58; agpl; 0.75; GRANT(?:gnu )?agpl(?: LIC)?
gfdl; 66; free documentation; 0.9; (?:GRANT)?gnu free documentation LIC(?: version| v)?(?: 1 [123])?
gfdl; 58; gfdl; 0.8; GRANTgfdl(?: 1 [123])?
bsd-2; 66; bsd; 0.9; (?:GRANT)?bsd (?:2|two) clause(?: LIC)?
bsd-2; 65; clause bsd; 0.9; (?:GRANT)?(?:2|two) clause bsd(?: LIC)?
bsd-2; 65; simplified bsd; 0.9; (?:GRANT)?simplified bsd(?: LIC)?
bsd-2; 64; freebsd; 0.8; GRANTfreebsd(?: LIC)?|freebsd LIC
bsd-3; 66; bsd; 0.9; (?:GRANT)?bsd (?:3|three) clause(?: LIC)?
bsd-3; 65; clause bsd; 0.9; (?:GRANT)?(?:3|three) clause bsd(?: LIC)?
bsd-3; 65; bsd; 0.9; (?:GRANT)?(?:new|revised|modified) bsd(?: LIC)?
bsd-4; 66; bsd; 0.9; (?:GRANT)?(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: LIC)?
bsd-0; 66; bsd; 0.85; (?:zero clause bsd|bsd zero clause|0bsd)(?: LIC)?
bsd; 56; bsd; 0.85; GRANTbsd(?: style| like)?(?: LIC)?
bsd; 48; bsd; 0.7; bsd(?: style| like)? LIC(?:d)?
mpl-2; 69; mozilla public; 0.95; (?:GRANT)?mozilla public LIC(?: version| v)? ?v?2(?: 0)?
mpl-1.1; 69; mozilla public; 0.95; (?:GRANT)?mozilla public LIC(?: version| v)? 1 [01]
mpl; 60; mozilla public; 0.8; (?:GRANT)?mozilla public(?: LIC)?
mpl-2; 62; mpl; 0.85; GRANTmpl ?(?:version |v )?v?2(?: 0)?
mpl; 54; mpl; 0.75; GRANTmpl(?: LIC)?
epl-1; 69; eclipse public; 0.95; (?:GRANT)?eclipse public LIC(?: version| v)? ?v?1(?: 0)?
epl-2; 69; eclipse public; 0.95; (?:GRANT)?eclipse public LIC(?: version| v)? ?v?2(?: 0)?
epl; 60; eclipse public; 0.8; (?:GRANT)?eclipse public(?: LIC)?
edl; 62; eclipse distribution; 0.85; (?:GRANT)?eclipse distribution LIC(?: (?:v |version )?1 0)?
cddl; 60; common development; 0.85; (?:GRANT)?common development and distribution LIC(?: version| v)?(?: 1 [01])?
cddl; 56; cddl; 0.8; GRANTcddl(?: (?:v |version )?1 [01])?
zlib; 58; zlib; 0.85; GRANTzlib(?: libpng)?(?: LIC)?|zlib(?: libpng)? LIC
artistic-2; 62; artistic; 0.85; (?:GRANT)?artistic LIC(?: version| v)? 2(?: 0)?
artistic-1; 62; artistic; 0.85; (?:GRANT)?artistic LIC(?: version| v)? 1(?: 0)?
artistic; 54; artistic; 0.75; (?:GRANT)?(?:perl )?artistic LIC
boost; 60; boost software; 0.85; (?:GRANT)?boost software LIC(?: version| v)?(?: 1 0)?
boost; 52; bsl 1; 0.6; GRANTbsl 1 0
unlicense; 60; unlicense; 0.85; GRANTunlicense|the unlicense
wtfpl; 60; wtfpl; 0.85; (?:GRANT)?wtfpl(?: (?:v |version )?2)?(?: LIC)?
eupl; 64; european union public; 0.9; (?:GRANT)?european union public LIC(?: (?:v |version )?1 [0-2])?
eupl; 58; eupl; 0.8; GRANTeupl(?: (?:v |version )?1 [0-2])?
cecill; 60; cecill; 0.85; (?:GRANT)?cecill(?: [abc12])?(?: LIC)?
ofl; 62; open font; 0.85; (?:GRANT)?(?:sil )?open font LIC(?: (?:v |version )?1 [01])?
odbl; 62; database; 0.85; (?:GRANT)?open (?:data commons open )?database LIC(?: (?:v |version )?1 0)?
odc-by; 62; open data commons attribution; 0.85; (?:GRANT)?open data commons attribution LIC
pddl; 62; public domain dedication; 0.85; (?:open data commons )?public domain dedication and LIC
psf; 60; python software foundation; 0.85; (?:GRANT)?python software foundation LIC(?: version 2)?
psf; 59; psf licen; 0.8; (?:GRANT)?psf LIC(?: version 2)?
postgresql; 58; postgresql licen; 0.85; (?:GRANT)?postgresql LIC
ncsa; 58; ncsa; 0.8; GRANTncsa(?: open source)?(?: LIC)?
ruby; 56; ruby licen; 0.8; (?:GRANT)?ruby LIC
php; 58; php licen; 0.8; (?:GRANT)?php LIC(?: (?:v |version )?3 0[01]?)?
vim; 54; vim licen; 0.8; (?:GRANT)?vim LIC
tcl; 54; tcl; 0.75; (?:GRANT)?tcl(?: tk)? LIC
qpl; 58; q public; 0.8; (?:GRANT)?q public LIC(?: 1 0)?
ibm-pl; 58; ibm public; 0.8; (?:GRANT)?ibm public LIC(?: 1 0)?
sleepycat; 58; sleepycat licen; 0.8; (?:GRANT)?sleepycat LIC
afl-3; 60; academic free; 0.85; (?:GRANT)?academic free LIC(?: (?:v |version )?[1-3](?: [0-2])?)?
osl-3; 60; open software licen; 0.8; (?:GRANT)?open software LIC(?: (?:v |version )?[1-3](?: [0-2])?)?
upl; 58; universal permissive; 0.85; (?:GRANT)?universal permissive LIC(?: (?:v |version )?1 0)?
mulan; 60; mulan; 0.85; (?:GRANT)?mulan (?:psl|permissive software LIC)(?: ?v?2)?
blueoak; 58; blue oak; 0.85; (?:GRANT)?blue oak model LIC(?: 1 0 0)?
ogl; 60; open government; 0.85; (?:GRANT)?open government LIC(?: (?:v |version )?[123](?: 0)?)?
proprietary; 52; proprietary; 0.7; (?:licensed under |under )(?:a |the |our )?proprietary LIC|proprietary and confidential
proprietary; 50; confidential+property of; 0.6; is the (?:confidential|sole|exclusive) (?:and proprietary )?property of (?:[^ ]+ ){1,6}confidential
shareware; 46; shareware; 0.6; (?:this (?:program|software) is|distributed as) shareware
freeware; 46; freeware; 0.6; (?:this (?:program|software) is|distributed as) freeware
"""

#: Short identifiers: SPDX tags, package fields and badges.
TAGS = r"""
mit; 85; spdx+mit; 0.97; spdx LIC identifier mit
apache-2; 85; spdx+apache; 0.97; spdx LIC identifier apache 2 0
bsd-2; 85; spdx+bsd; 0.97; spdx LIC identifier bsd 2 clause
bsd-3; 85; spdx+bsd; 0.97; spdx LIC identifier bsd 3 clause
bsd-4; 85; spdx+bsd; 0.97; spdx LIC identifier bsd 4 clause
bsd-0; 85; spdx+0bsd; 0.97; spdx LIC identifier 0bsd
isc; 85; spdx+isc; 0.97; spdx LIC identifier isc
gpl-2; 85; spdx+gpl 2; 0.97; spdx LIC identifier gpl 2 0(?: only)?
gpl-2-or-later; 86; spdx+gpl 2 0 or later; 0.97; spdx LIC identifier gpl 2 0 or later
gpl-3; 85; spdx+gpl 3; 0.97; spdx LIC identifier gpl 3 0(?: only)?
gpl-3-or-later; 86; spdx+gpl 3 0 or later; 0.97; spdx LIC identifier gpl 3 0 or later
lgpl-2.1; 85; spdx+lgpl 2 1; 0.97; spdx LIC identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later; 86; spdx+lgpl 2 1 or later; 0.97; spdx LIC identifier lgpl 2 1 or later
lgpl-3; 85; spdx+lgpl 3; 0.97; spdx LIC identifier lgpl 3 0(?: only| or later)?
agpl-3; 85; spdx+agpl 3; 0.97; spdx LIC identifier agpl 3 0(?: only| or later)?
mpl-2; 85; spdx+mpl 2; 0.97; spdx LIC identifier mpl 2 0
epl-1; 85; spdx+epl 1; 0.97; spdx LIC identifier epl 1 0
epl-2; 85; spdx+epl 2; 0.97; spdx LIC identifier epl 2 0
cddl; 85; spdx+cddl; 0.97; spdx LIC identifier cddl 1 [01]
zlib; 85; spdx+zlib; 0.97; spdx LIC identifier zlib
boost; 85; spdx+bsl 1 0; 0.97; spdx LIC identifier bsl 1 0
unlicense; 85; spdx+unlicense; 0.97; spdx LIC identifier unlicense
cc0; 85; spdx+cc0; 0.97; spdx LIC identifier cc0 1 0
cc-by; 85; spdx+cc by; 0.97; spdx LIC identifier cc by [1-4] [05]
cc-by-sa; 85; spdx+cc by sa; 0.97; spdx LIC identifier cc by sa [1-4] [05]
cc-by-nc; 85; spdx+cc by nc; 0.97; spdx LIC identifier cc by nc [1-4] [05]
artistic-2; 85; spdx+artistic; 0.97; spdx LIC identifier artistic 2 0
wtfpl; 85; spdx+wtfpl; 0.97; spdx LIC identifier wtfpl
ofl; 85; spdx+ofl; 0.97; spdx LIC identifier ofl 1 1
unknown-spdx; 20; spdx; 0.5; spdx LIC identifier [^ ]+
mit; 47; mit; 0.75; (?:project |package )?LIC (?:is )?mit
apache-2; 47; apache 2; 0.8; (?:project |package )?LIC (?:is )?apache 2(?: 0)?
gpl-2; 47; gpl; 0.75; (?:project |package )?LIC (?:is )?gpl ?v?2(?: 0)?(?: or later)?
gpl-3; 47; gpl; 0.75; (?:project |package )?LIC (?:is )?gpl ?v?3(?: 0)?(?: or later)?
bsd; 47; bsd; 0.7; (?:project |package )?LIC (?:is )?bsd(?: [23] clause)?
mpl-2; 47; mpl; 0.75; (?:project |package )?LIC (?:is )?mpl 2(?: 0)?
osi; 40; osi approved; 0.6; LIC osi approved [^ ]+(?: [^ ]+){0,3} LIC
"""

#: Creative Commons: short names, deeds and sentences in full.
COMMONS = r"""
cc-by; 60; cc by; 0.8; (?:GRANT)?cc by(?: [1-4] [05])?(?: LIC| international| unported| deed)?
cc-by-sa; 68; cc by sa; 0.9; (?:GRANT)?cc by sa(?: [1-4] [05])?(?: LIC| international| unported| deed)?
cc-by-nd; 68; cc by nd; 0.9; (?:GRANT)?cc by nd(?: [1-4] [05])?(?: LIC| international| unported| deed)?
cc-by-nc; 68; cc by nc; 0.9; (?:GRANT)?cc by nc(?: [1-4] [05])?(?: LIC| international| unported| deed)?
cc-by-nc-sa; 74; cc by nc sa; 0.95; (?:GRANT)?cc by nc sa(?: [1-4] [05])?(?: LIC| international| unported| deed)?
cc-by-nc-nd; 74; cc by nc nd; 0.95; (?:GRANT)?cc by nc nd(?: [1-4] [05])?(?: LIC| international| unported| deed)?
cc0; 68; cc0; 0.9; (?:GRANT)?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?(?: LIC)?
cc0; 70; creative commons+zero; 0.9; creative commons (?:cc )?zero(?: 1 0)?(?: universal)?(?: LIC)?
cc-pdm; 66; public domain mark; 0.85; (?:creative commons )?public domain mark(?: 1 0)?
cc-by; 62; creative commons+attribution; 0.85; (?:GRANT)?creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: LIC)?
cc-by; 61; creative commons+by; 0.8; (?:GRANT)?creative commons by(?: [1-4] [05])?(?: LIC)?
cc-by-sa; 72; creative commons+attribution share; 0.95; (?:GRANT)?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: LIC)?
cc-by-sa; 71; creative commons+by sa; 0.9; (?:GRANT)?creative commons by sa(?: [1-4] [05])?(?: LIC)?
cc-by-nd; 72; creative commons+attribution no; 0.95; (?:GRANT)?creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: LIC)?
cc-by-nd; 71; creative commons+by nd; 0.9; (?:GRANT)?creative commons by nd(?: [1-4] [05])?(?: LIC)?
cc-by-nc; 72; creative commons+attribution non; 0.95; (?:GRANT)?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: LIC)?
cc-by-nc; 71; creative commons+by nc; 0.9; (?:GRANT)?creative commons by nc(?: [1-4] [05])?(?: LIC)?
cc-by-nc-sa; 78; creative commons+commercial share; 0.97; (?:GRANT)?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: LIC)?
cc-by-nc-sa; 77; creative commons+by nc sa; 0.95; (?:GRANT)?creative commons by nc sa(?: [1-4] [05])?(?: LIC)?
cc-by-nc-nd; 78; creative commons+commercial no; 0.97; (?:GRANT)?creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: LIC)?
cc-by-nc-nd; 77; creative commons+by nc nd; 0.95; (?:GRANT)?creative commons by nc nd(?: [1-4] [05])?(?: LIC)?
cc-by; 76; creativecommons org licenses by; 0.95; (?:https? )?creativecommons org licenses by [1-4] [05]
cc-by-sa; 76; creativecommons org licenses by sa; 0.95; (?:https? )?creativecommons org licenses by sa [1-4] [05]
cc-by-nd; 76; creativecommons org licenses by nd; 0.95; (?:https? )?creativecommons org licenses by nd [1-4] [05]
cc-by-nc; 76; creativecommons org licenses by nc; 0.95; (?:https? )?creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa; 79; creativecommons org licenses by nc sa; 0.97; (?:https? )?creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd; 79; creativecommons org licenses by nc nd; 0.97; (?:https? )?creativecommons org licenses by nc nd [1-4] [05]
cc0; 76; creativecommons org publicdomain; 0.95; (?:https? )?creativecommons org publicdomain zero 1 0
creative-commons; 40; creative commons licen; 0.6; (?:some rights reserved )?(?:GRANT)?creative commons LIC
"""

#: Addresses, the public domain, and notices that name no license.
NOTICES = r"""
mit; 75; opensource org licenses mit; 0.95; (?:https? )?(?:www )?opensource org licenses mit(?: LIC)?(?: php)?
apache-2; 74; apache org licenses license 2; 0.9; (?:https? )?www apache org licenses license 2 0(?: txt| html)?
gpl; 65; gnu org licenses; 0.8; (?:https? )?www gnu org licenses(?: gpl(?: [23] 0)?)?(?: html| txt)?
lgpl; 66; gnu org licenses lgpl; 0.85; (?:https? )?www gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?
agpl; 66; gnu org licenses agpl; 0.85; (?:https? )?www gnu org licenses agpl(?: 3 0)?(?: html| txt)?
bsd-3; 72; opensource org licenses bsd; 0.85; (?:https? )?(?:www )?opensource org licenses bsd 3 clause
bsd-2; 72; opensource org licenses bsd; 0.85; (?:https? )?(?:www )?opensource org licenses bsd 2 clause
ofl; 72; scripts sil org ofl; 0.9; (?:https? )?scripts sil org ofl
unlicense; 74; unlicense org; 0.9; (?:https? )?unlicense org
wtfpl; 72; wtfpl net; 0.85; (?:https? )?www wtfpl net
public-domain; 55; public domain; 0.8; (?:released|placed|dedicated|donated|put) (?:in|in to|into|to) the public domain
public-domain; 52; public domain; 0.75; (?:hereby )?(?:place|dedicate|release|waive)s? (?:[^ ]+ ){1,6}(?:in|in to|into|to) the public domain
public-domain; 40; public domain; 0.5; (?:is|are|as) (?:in |a )?(?:the )?public domain(?: work| software)?
public-domain; 44; no known copyright; 0.6; (?:there (?:are|is) )?no known copyright restrictions?
us-gov; 50; work of the u; 0.75; is a work of the u s government(?: and is in the public domain)?
crown; 48; crown copyright; 0.7; (?:c )?crown copyright(?: [0-9]{4})?
all-rights-reserved; 30; rights reserved; 0.6; (?:copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,4})?all rights reserved
some-rights-reserved; 28; rights reserved; 0.5; some rights reserved
no-reproduction; 34; no part of this; 0.7; no part of this (?:publication|book|document|work|material|website) may be (?:reproduced|copied|distributed|stored)
no-reproduction; 32; written permission; 0.6; without (?:the )?(?:prior |express )+written permission(?: of (?:the )?(?:publisher|author|copyright (?:holder|owner)))?
no-reproduction; 31; prohibited; 0.55; unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication)(?: or (?:copying|use|reproduction|distribution|duplication))?(?: of this (?:file|material|content|document))?(?: via any medium)? is (?:strictly )?prohibited
no-ai-training; 60; machine learning; 0.7; may not be used (?:to train|for (?:the )?training(?: of)?) (?:[^ ]+ ){0,4}machine learning(?: models?)?
no-ai-training; 62; artificial intelligence; 0.75; (?:may not be used|do not use|no permission is granted) (?:[^ ]+ ){1,5}(?:train|training) (?:of )?(?:[^ ]+ ){0,4}artificial intelligence
personal-use; 45; personal; 0.6; for (?:your )?personal (?:and )?non ?commercial use only|for personal use only
noncommercial; 44; commercial; 0.6; for non ?commercial (?:use|purposes) only|commercial use (?:is )?(?:strictly )?(?:prohibited|forbidden|not (?:allowed|permitted))
research-only; 46; research; 0.65; for (?:academic |non ?commercial )?research (?:use|purposes) only
educational-use; 44; education; 0.55; for educational (?:use|purposes) only
terms-of-use; 25; terms of; 0.4; (?:by using|use of) this (?:site|website|service|software) (?:you agree|is subject|constitutes acceptance)(?: to| of)?(?: the| our| these)? terms of (?:use|service)
eula; 36; end user licen; 0.6; end user LIC agreement
trademark; 18; trademark; 0.3; (?:is|are) (?:a )?(?:registered )?trademarks? of
warranty-disclaimer; 20; as is without warrant; 0.4; (?:provided )?as is without warrant(?:y|ies) of any kind
liability-disclaimer; 18; in no event shall; 0.35; in no event shall (?:[^ ]+ ){1,8}be liable
copyright-notice; 15; copyright; 0.3; copyright (?:c )?[0-9]{4}(?: [0-9]{4})?
copyright-notice; 14; _c_; 0.25; c (?:19|20)[0-9]{2} (?:by )?(?:[^ ]+ ){1,4}(?:inc|ltd|llc|gmbh|corp|corporation|foundation)
copyleft; 16; copyleft; 0.3; copyleft(?: and attribution)?
see-license-file; 24; see_; 0.5; see (?:the )?(?:accompanying |included |attached )?(?:LIC|copying|notice)(?: (?:file|txt|md))? (?:for|in) (?:the )?(?:full |more |LIC |root |project |top )*(?:details|information|terms|text|directory|level)
lizenz; 26; lizenz; 0.5; (?:steht|veröffentlicht|lizenziert) unter (?:der )?(?:[^ ]+ ){1,6}lizenz
licencia; 26; licencia; 0.5; (?:bajo|con) (?:la |una )?licencia (?:[^ ]+ ){0,4}(?:mit|apache|gpl|gnu|bsd|creative commons|libre)
licence-fr; 26; sous_; 0.5; sous (?:la |une )?licence (?:[^ ]+ ){0,4}(?:mit|apache|gpl|gnu|bsd|creative commons|libre)
alle-rechte; 28; alle rechte vorbehalten; 0.6; alle rechte vorbehalten
todos-derechos; 28; derechos reservados; 0.6; todos los derechos reservados
tous-droits; 28; droits; 0.6; tous droits réservés
"""

TABLES = (TEXTS, NAMES, TAGS, COMMONS, NOTICES)
