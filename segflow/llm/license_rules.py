"""Signature rules of licenses, one a line: label | priority | keyword | expression.

Expressions run over the words of a text, in lower case and joined by one space, and match whole
words. ``keyword`` is a word that every match holds; rules whose keyword a text has not are not
tried. Priorities: 1 passages of a license text, 2 notices and grants, 3 tags and addresses,
4 names with a version, 5 bare names. Abbreviations in expressions: ``L`` license or licence,
``D`` licensed or licenced or released or distributed or published or available, ``<2.0>`` and ``<2>`` a version with or
without v or version, ``SPDX`` the words of an SPDX tag, ``*`` up to twelve words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TABLE = r"""
mit | 1 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 2 | mit | D under (?:the )?(?:terms of )?(?:the )?mit L
mit | 2 | mit | (?:code|project|software|package|library|work) is (?:D )?under (?:the )?mit
mit | 3 | mit | SPDX mit
mit | 3 | opensource | opensource org licenses mit(?: L)?(?: php| html)?
mit | 3 | mit | L mit
mit | 5 | mit | (?:the )?mit(?: x11| expat| style)? L
mit-0 | 3 | mit | SPDX mit 0
mit-0 | 4 | mit | mit no attribution(?: L)?
x11 | 4 | x11 | (?:the )?x11 L
expat | 5 | expat | (?:the )?expat L
apache-2.0 | 1 | contributor | subject to the terms and conditions of this L each contributor hereby grants to you a perpetual worldwide non exclusive
apache-2.0 | 1 | apache | unless required by applicable law or agreed to in writing software distributed under the L is distributed on an as is basis *(?: apache)
apache-2.0 | 2 | apache | D under (?:the )?(?:terms of )?(?:the )?apache(?: software foundation)?(?: software)? L <2>
apache-2.0 | 2 | apache | D under (?:the )?apache <2>
apache-2.0 | 3 | apache | SPDX apache 2 0(?: only| or later)?
apache-2.0 | 3 | apache | (?:www )?apache org licenses L 2 0(?: txt| html)?
apache-2.0 | 3 | opensource | opensource org licenses apache 2 0(?: php)?
apache-2.0 | 4 | apache | apache(?: public| software)? L <2>
apache-2.0 | 4 | apache | apache 2(?: 0)? L
apache-2.0 | 4 | asl | asl <2>
apache-1.1 | 3 | apache | SPDX apache 1 1
apache-1.1 | 4 | apache | apache(?: software)? L <1.1>
apache-1.0 | 3 | apache | SPDX apache 1 0
apache-1.0 | 4 | apache | apache(?: software)? L <1.0>
apache | 2 | apache | D under (?:the )?(?:terms of )?(?:the )?apache L
apache | 5 | apache | (?:the )?apache(?: public| software)? L
gpl-3.0 | 1 | copyleft | the gnu general public L is a free copyleft L for software and other kinds of works
gpl-3.0 | 1 | propagate | to propagate a work means to do anything with it that without permission would make you directly or secondarily liable
gpl-3.0-or-later | 2 | gnu | terms of (?:the )?gnu general public L as published by the free software foundation either <3>(?: of the L)? or at your option any later version
gpl-3.0-only | 2 | gnu | terms of (?:the )?gnu general public L <3> (?:only )?as published by the free software foundation
gpl-3.0 | 2 | gnu | D under (?:the )?(?:terms of )?(?:the )?gnu general public L <3>
gpl-3.0 | 2 | gnu | D under (?:the )?(?:terms of )?(?:the )?gnu gpl <3>
gpl-3.0 | 2 | gpl | D under (?:the )?(?:terms of )?(?:the )?gpl <3>
gpl-3.0-only | 3 | gpl | SPDX gpl 3 0(?: only)?
gpl-3.0-or-later | 3 | gpl | SPDX gpl 3 0 or later
gpl-3.0 | 3 | gnu | gnu org licenses (?:old licenses )?gpl 3 0(?: html| txt| en html)?
gpl-3.0 | 3 | opensource | opensource org licenses gpl 3 0(?: html)?
gpl-3.0 | 4 | gnu | (?:the )?gnu general public L <3>
gpl-3.0 | 4 | gpl | (?:gnu )?gpl <3>
gpl-3.0 | 4 | gplv3 | (?:gnu )?gplv3
gpl-3.0-or-later | 4 | gplv3 | gplv3 (?:or later|or newer)
gpl-2.0 | 1 | gnu | the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public L
gpl-2.0-or-later | 2 | gnu | terms of (?:the )?gnu general public L as published by the free software foundation either <2>(?: of the L)? or at your option any later version
gpl-2.0-only | 2 | gnu | terms of (?:the )?gnu general public L <2> (?:only )?as published by the free software foundation
gpl-2.0 | 2 | gnu | D under (?:the )?(?:terms of )?(?:the )?gnu general public L <2>
gpl-2.0 | 2 | gpl | D under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl <2>
gpl-2.0-only | 3 | gpl | SPDX gpl 2 0(?: only)?
gpl-2.0-or-later | 3 | gpl | SPDX gpl 2 0 or later
gpl-2.0 | 3 | gnu | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
gpl-2.0 | 3 | opensource | opensource org licenses gpl 2 0(?: php)?
gpl-2.0 | 4 | gnu | (?:the )?gnu general public L <2>
gpl-2.0 | 4 | gpl | (?:gnu )?gpl <2>
gpl-2.0 | 4 | gplv2 | (?:gnu )?gplv2
gpl-2.0-or-later | 4 | gplv2 | gplv2 (?:or later|or newer)
gpl-2.0-classpath | 2 | linking | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-2.0-classpath | 4 | classpath | gpl(?:v2| 2 0| 2)? with (?:the )?classpath exception
gpl-1.0 | 3 | gpl | SPDX gpl 1 0(?: only| or later)?
gpl | 2 | gnu | D under (?:the )?(?:terms of )?(?:the )?gnu general public L
gpl | 2 | gpl | D under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl | 3 | gnu | gnu org (?:licenses|copyleft) gpl(?: html| txt)?
gpl | 5 | gnu | (?:the )?gnu general public L
gpl | 5 | gpl | (?:the )?gnu gpl
lgpl-3.0 | 1 | lesser | this version of the gnu lesser general public L incorporates the terms and conditions of version 3 of the gnu general public L
lgpl-3.0 | 2 | lesser | D under (?:the )?(?:terms of )?(?:the )?gnu lesser general public L <3>
lgpl-3.0-or-later | 2 | lesser | terms of (?:the )?gnu lesser general public L as published by the free software foundation either <3>(?: of the L)? or at your option any later version
lgpl-3.0-only | 3 | lgpl | SPDX lgpl 3 0(?: only)?
lgpl-3.0-or-later | 3 | lgpl | SPDX lgpl 3 0 or later
lgpl-3.0 | 3 | lgpl | gnu org licenses lgpl 3 0(?: html| txt)?
lgpl-3.0 | 4 | lesser | (?:the )?gnu lesser general public L <3>
lgpl-3.0 | 4 | lgpl | (?:gnu )?lgpl <3>
lgpl-3.0 | 4 | lgplv3 | (?:gnu )?lgplv3
lgpl-2.1 | 1 | lesser | the lesser general public L permits more lax criteria for linking other code with the library
lgpl-2.1 | 2 | lesser | D under (?:the )?(?:terms of )?(?:the )?gnu lesser general public L <2.1>
lgpl-2.1-or-later | 2 | lesser | terms of (?:the )?gnu lesser general public L as published by the free software foundation either <2.1>(?: of the L)? or at your option any later version
lgpl-2.1-only | 3 | lgpl | SPDX lgpl 2 1(?: only)?
lgpl-2.1-or-later | 3 | lgpl | SPDX lgpl 2 1 or later
lgpl-2.1 | 3 | lgpl | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-2.1 | 4 | lesser | (?:the )?gnu lesser general public L <2.1>
lgpl-2.1 | 4 | lgpl | (?:gnu )?lgpl <2.1>
lgpl-2.1 | 4 | lgplv2 | (?:gnu )?lgplv2 1
lgpl-2.0 | 2 | library | D under (?:the )?(?:terms of )?(?:the )?gnu library general public L
lgpl-2.0 | 3 | lgpl | SPDX lgpl 2 0(?: only| or later)?
lgpl-2.0 | 4 | library | (?:the )?gnu library general public L(?: <2>)?
lgpl | 2 | lgpl | D under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
lgpl | 5 | lesser | (?:the )?(?:gnu )?lesser general public L
lgpl | 5 | lgpl | (?:the )?gnu lgpl
agpl-3.0 | 1 | affero | the gnu affero general public L is a free copyleft L for software and other kinds of works
agpl-3.0 | 1 | interacting | your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-3.0-or-later | 2 | affero | terms of (?:the )?gnu affero general public L as published by the free software foundation either <3>(?: of the L)? or at your option any later version
agpl-3.0 | 2 | affero | D under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public L(?: <3>)?
agpl-3.0-only | 3 | agpl | SPDX agpl 3 0(?: only)?
agpl-3.0-or-later | 3 | agpl | SPDX agpl 3 0 or later
agpl-3.0 | 3 | agpl | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
agpl-3.0 | 4 | affero | (?:the )?gnu affero general public L <3>
agpl-3.0 | 4 | agpl | (?:gnu )?agpl <3>
agpl-3.0 | 4 | agplv3 | (?:gnu )?agplv3
agpl | 5 | affero | (?:the )?(?:gnu )?affero general public L
gfdl | 1 | invariant | copy distribute and or modify this document under the terms of the gnu free documentation L *(?: invariant) sections
gfdl-1.3 | 3 | gfdl | SPDX gfdl 1 3(?: only| or later)?
gfdl-1.3 | 4 | documentation | (?:the )?gnu free documentation L <1.3>
gfdl-1.2 | 3 | gfdl | SPDX gfdl 1 2(?: only| or later)?
gfdl-1.2 | 4 | documentation | (?:the )?gnu free documentation L <1.2>
gfdl | 5 | documentation | (?:the )?gnu free documentation L
bsd-3-clause | 1 | neither | neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of (?:its|any|the) (?:[^ ]+ ){0,3}?(?:contributors|authors)? ?may be used to endorse or promote products derived from this software
bsd-3-clause | 2 | bsd | D under (?:the )?(?:terms of )?(?:the )?(?:3 clause|three clause|new|modified|revised) bsd L
bsd-3-clause | 2 | bsd | D under (?:the )?(?:terms of )?(?:the )?bsd 3(?: clause)?(?: L)?
bsd-3-clause | 3 | bsd | SPDX bsd 3 clause
bsd-3-clause | 3 | opensource | opensource org licenses bsd 3 clause
bsd-3-clause | 4 | bsd | (?:3 clause|three clause|new|modified|revised) bsd L
bsd-3-clause | 4 | bsd | bsd (?:3|three) clause(?: L)?
bsd-2-clause | 1 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 2 | bsd | D under (?:the )?(?:terms of )?(?:the )?(?:2 clause|two clause|simplified|freebsd) bsd L
bsd-2-clause | 3 | bsd | SPDX bsd 2 clause(?: patent| views)?
bsd-2-clause | 3 | opensource | opensource org licenses bsd 2 clause
bsd-2-clause | 4 | bsd | (?:2 clause|two clause|simplified) bsd L
bsd-2-clause | 4 | bsd | bsd (?:2|two) clause(?: L)?
bsd-4-clause | 1 | acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause | 3 | bsd | SPDX bsd 4 clause(?: uc)?
bsd-4-clause | 4 | bsd | (?:4 clause|four clause|original) bsd L
0bsd | 3 | 0bsd | SPDX 0bsd
0bsd | 4 | bsd | (?:zero clause bsd|bsd zero clause)(?: L)?
bsd | 2 | bsd | D under (?:the )?(?:terms of )?(?:the )?bsd(?: style)? L
bsd | 3 | opensource | opensource org licenses bsd L(?: php)?
bsd | 5 | bsd | (?:the )?bsd(?: style)? L
isc | 1 | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted *(?: isc)
isc | 1 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | D under (?:the )?(?:terms of )?(?:the )?isc L
isc | 3 | isc | SPDX isc
isc | 3 | opensource | opensource org licenses isc(?: L)?(?: txt)?
isc | 5 | isc | (?:the )?isc L
mpl-2.0 | 1 | mozilla | this source code form is subject to the terms of the mozilla public L v 2 0
mpl-2.0 | 2 | mozilla | D under (?:the )?(?:terms of )?(?:the )?mozilla public L <2>
mpl-2.0 | 2 | mpl | D under (?:the )?(?:terms of )?(?:the )?mpl <2>
mpl-2.0 | 3 | mpl | SPDX mpl 2 0(?: no copyleft exception)?
mpl-2.0 | 3 | mozilla | mozilla org (?:en us )?mpl 2 0
mpl-2.0 | 4 | mozilla | mozilla public L <2>
mpl-2.0 | 4 | mpl | mpl <2.0>
mpl-1.1 | 2 | mozilla | the contents of this file are subject to the mozilla public L <1.1>
mpl-1.1 | 3 | mpl | SPDX mpl 1 1
mpl-1.1 | 4 | mozilla | mozilla public L <1.1>
mpl-1.0 | 3 | mpl | SPDX mpl 1 0
mpl-1.0 | 4 | mozilla | mozilla public L <1.0>
mpl | 5 | mozilla | (?:the )?mozilla public L
epl-2.0 | 2 | eclipse | under the terms of the eclipse public L <2>
epl-2.0 | 3 | epl | SPDX epl 2 0
epl-2.0 | 3 | eclipse | eclipse org legal epl (?:v20|2 0)(?: html)?
epl-2.0 | 4 | eclipse | eclipse public L <2>
epl-1.0 | 2 | eclipse | under the terms of the eclipse public L <1.0>
epl-1.0 | 3 | epl | SPDX epl 1 0
epl-1.0 | 3 | eclipse | eclipse org legal epl v10(?: html)?
epl-1.0 | 4 | eclipse | eclipse public L <1.0>
epl | 5 | eclipse | (?:the )?eclipse public L
edl-1.0 | 4 | eclipse | eclipse distribution L(?: <1.0>)?
cpl-1.0 | 4 | common | common public L(?: <1.0>)
cddl-1.1 | 3 | cddl | SPDX cddl 1 1
cddl-1.1 | 4 | cddl | cddl <1.1>
cddl-1.0 | 3 | cddl | SPDX cddl 1 0
cddl-1.0 | 4 | cddl | cddl <1.0>
cddl-1.0 | 4 | distribution | common development and distribution L <1.0>
cddl | 5 | distribution | (?:the )?common development and distribution L
cc0-1.0 | 1 | cc0 | (?:the )?person who associated a work with this deed has dedicated the work to the public domain *(?: cc0)
cc0-1.0 | 2 | cc0 | D under (?:the )?(?:terms of )?(?:the )?cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 3 | cc0 | SPDX cc0 1 0
cc0-1.0 | 3 | creativecommons | creativecommons org publicdomain zero 1 0(?: deed| legalcode)?
cc0-1.0 | 4 | cc0 | cc0 1 0(?: universal)?(?: public domain dedication)?
cc0-1.0 | 5 | creative | (?:creative commons )(?:cc0|zero)(?: L)?
cc-by-4.0 | 2 | cc | D under (?:the )?(?:a )?cc by <4>(?: L)?
cc-by-4.0 | 2 | creative | D under (?:the )?(?:a )?(?:terms of the )?creative commons attribution <4>(?: international)?(?: public)?(?: L)?
cc-by-4.0 | 3 | cc | SPDX cc by 4 0
cc-by-4.0 | 3 | creativecommons | creativecommons org licenses by 4 0(?: deed| legalcode)?
cc-by-4.0 | 4 | cc | cc by <4>(?: international)?
cc-by-4.0 | 4 | creative | creative commons attribution <4>(?: international)?(?: public)?(?: L)?
cc-by-3.0 | 3 | creativecommons | creativecommons org licenses by 3 0(?: deed| legalcode)?
cc-by-3.0 | 4 | cc | cc by <3>(?: unported)?
cc-by-3.0 | 4 | creative | creative commons attribution <3>(?: unported)?(?: L)?
cc-by-2.5 | 3 | creativecommons | creativecommons org licenses by 2 5
cc-by-2.5 | 4 | cc | cc by <2.5>
cc-by-2.0 | 3 | creativecommons | creativecommons org licenses by 2 0
cc-by-2.0 | 4 | cc | cc by <2.0>
cc-by | 4 | creative | creative commons attribution L
cc-by | 5 | cc | cc by
cc-by-sa-4.0 | 2 | cc | D under (?:the )?(?:a )?cc by sa <4>(?: L)?
cc-by-sa-4.0 | 2 | creative | D under (?:the )?(?:a )?creative commons attribution share ?alike <4>(?: international)?(?: public)?(?: L)?
cc-by-sa-4.0 | 3 | cc | SPDX cc by sa 4 0
cc-by-sa-4.0 | 3 | creativecommons | creativecommons org licenses by sa 4 0(?: deed| legalcode)?
cc-by-sa-4.0 | 4 | cc | cc by sa <4>
cc-by-sa-4.0 | 4 | creative | creative commons attribution share ?alike <4>(?: international)?(?: public)?(?: L)?
cc-by-sa-3.0 | 3 | creativecommons | creativecommons org licenses by sa 3 0(?: deed| legalcode)?
cc-by-sa-3.0 | 4 | cc | cc by sa <3>(?: unported)?
cc-by-sa-3.0 | 4 | creative | creative commons attribution share ?alike <3>(?: unported)?(?: L)?
cc-by-sa | 4 | cc | cc by sa
cc-by-sa | 5 | creative | creative commons attribution share ?alike(?: L)?
cc-by-nc-4.0 | 2 | cc | D under (?:the )?(?:a )?cc by nc <4>(?: L)?
cc-by-nc-4.0 | 2 | creative | D under (?:the )?(?:a )?creative commons attribution non ?commercial <4>(?: international)?(?: public)?(?: L)?
cc-by-nc-4.0 | 3 | cc | SPDX cc by nc 4 0
cc-by-nc-4.0 | 3 | creativecommons | creativecommons org licenses by nc 4 0(?: deed| legalcode)?
cc-by-nc-4.0 | 4 | cc | cc by nc <4>
cc-by-nc-4.0 | 4 | creative | creative commons attribution non ?commercial <4>(?: international)?(?: public)?(?: L)?
cc-by-nc-3.0 | 4 | cc | cc by nc <3>(?: unported)?
cc-by-nc | 4 | cc | cc by nc
cc-by-nc | 5 | creative | creative commons attribution non ?commercial(?: L)?
cc-by-nd-4.0 | 3 | creativecommons | creativecommons org licenses by nd 4 0(?: deed| legalcode)?
cc-by-nd-4.0 | 4 | cc | cc by nd <4>
cc-by-nd-4.0 | 4 | creative | creative commons attribution no ?deriv(?:ative)?s <4>(?: international)?(?: public)?(?: L)?
cc-by-nd | 4 | cc | cc by nd
cc-by-nc-sa-4.0 | 2 | cc | D under (?:the )?(?:a )?cc by nc sa <4>(?: L)?
cc-by-nc-sa-4.0 | 3 | cc | SPDX cc by nc sa 4 0
cc-by-nc-sa-4.0 | 3 | creativecommons | creativecommons org licenses by nc sa 4 0(?: deed| legalcode)?
cc-by-nc-sa-4.0 | 4 | cc | cc by nc sa <4>
cc-by-nc-sa-4.0 | 4 | creative | creative commons attribution non ?commercial share ?alike <4>(?: international)?(?: public)?(?: L)?
cc-by-nc-sa-3.0 | 4 | cc | cc by nc sa <3>(?: unported)?
cc-by-nc-sa | 4 | cc | cc by nc sa
cc-by-nc-nd-4.0 | 2 | cc | D under (?:the )?(?:a )?cc by nc nd <4>(?: L)?
cc-by-nc-nd-4.0 | 3 | cc | SPDX cc by nc nd 4 0
cc-by-nc-nd-4.0 | 3 | creativecommons | creativecommons org licenses by nc nd 4 0(?: deed| legalcode)?
cc-by-nc-nd-4.0 | 4 | cc | cc by nc nd <4>
cc-by-nc-nd-4.0 | 4 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s <4>(?: international)?(?: public)?(?: L)?
cc-by-nc-nd | 4 | cc | cc by nc nd
cc-pdm-1.0 | 3 | creativecommons | creativecommons org publicdomain mark 1 0
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | D under (?:the )?(?:terms of )?(?:the )?unlicense
unlicense | 3 | unlicense | SPDX unlicense
unlicense | 3 | unlicense | unlicense org
public-domain | 2 | domain | (?:released|dedicated|placed|put) (?:in|to|into) the public domain
public-domain | 4 | domain | (?:is|are) in the public domain
wtfpl | 1 | fuck | do what the fuck you want to public L
wtfpl | 3 | wtfpl | SPDX wtfpl
wtfpl | 5 | wtfpl | (?:the )?wtfpl(?: L)?
zlib | 1 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 3 | zlib | SPDX zlib(?: acknowledgement)?
zlib | 5 | zlib | (?:the )?zlib(?: libpng)? L
libpng | 3 | libpng | SPDX libpng(?: 2 0)?
libpng | 5 | libpng | (?:the )?libpng L
bsl-1.0 | 1 | boost | boost software L version 1 0 august 17th 2003
bsl-1.0 | 2 | boost | (?:distributed|D) under the boost software L <1.0>
bsl-1.0 | 3 | bsl | SPDX bsl 1 0
bsl-1.0 | 3 | boost | boost org L 1 0(?: txt)?
bsl-1.0 | 4 | boost | boost software L <1.0>
bsl-1.0 | 5 | boost | (?:the )?boost software L
busl-1.1 | 3 | busl | SPDX busl 1 1
busl-1.1 | 4 | business | business source L(?: <1.1>)?
sspl-1.0 | 3 | sspl | SPDX sspl 1 0
sspl-1.0 | 4 | server | server side public L(?: <1>)?
elastic-2.0 | 3 | elastic | SPDX elastic 2 0
elastic-2.0 | 4 | elastic | elastic L <2>
artistic-2.0 | 2 | artistic | D under (?:the )?(?:terms of )?(?:the )?artistic L <2>
artistic-2.0 | 3 | artistic | SPDX artistic 2 0
artistic-2.0 | 4 | artistic | artistic L <2>
artistic-1.0 | 3 | artistic | SPDX artistic 1 0(?: perl| cl8)?
artistic | 5 | artistic | (?:the )?(?:perl )?artistic L
perl | 2 | perl | you can redistribute it and or modify it under the same terms as perl itself
eupl-1.2 | 2 | eupl | D under (?:the )?(?:terms of )?(?:the )?eupl(?: <1.2>)?
eupl-1.2 | 3 | eupl | SPDX eupl 1 2
eupl-1.2 | 4 | union | european union public L(?: <1.2>)?
eupl-1.1 | 3 | eupl | SPDX eupl 1 1
osl-3.0 | 3 | osl | SPDX osl 3 0
osl-3.0 | 4 | open | open software L <3>
afl-3.0 | 3 | afl | SPDX afl 3 0
afl-3.0 | 4 | academic | academic free L <3>
ecl-2.0 | 3 | ecl | SPDX ecl 2 0
ecl-2.0 | 4 | educational | educational community L <2>
ms-pl | 3 | ms | SPDX ms pl
ms-pl | 5 | microsoft | microsoft public L
ms-rl | 3 | ms | SPDX ms rl
ms-rl | 5 | microsoft | microsoft reciprocal L
python-2.0 | 3 | psf | SPDX psf 2 0
python-2.0 | 3 | python | SPDX python 2 0
python-2.0 | 4 | python | python software foundation L(?: <2>)?
php-3.01 | 3 | php | SPDX php 3 01
php-3.01 | 4 | php | php L <3.01>
postgresql | 3 | postgresql | SPDX postgresql
postgresql | 5 | postgresql | (?:the )?postgresql L
openssl | 1 | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 3 | openssl | SPDX openssl
openssl | 5 | openssl | (?:the )?openssl L
ncsa | 3 | ncsa | SPDX ncsa
ncsa | 5 | ncsa | university of illinois ncsa open source L
unicode | 3 | unicode | SPDX unicode(?: dfs 2016| 3 0| tou)
unicode | 5 | unicode | unicode L agreement
ofl-1.1 | 2 | ofl | D under (?:the )?(?:terms of )?(?:the )?(?:sil )?ofl(?: <1.1>)?
ofl-1.1 | 3 | ofl | SPDX ofl 1 1(?: rfn| no rfn)?
ofl-1.1 | 4 | sil | sil open font L(?: <1.1>)?
odbl-1.0 | 2 | database | made available under the open database L
odbl-1.0 | 3 | odbl | SPDX odbl 1 0
odbl-1.0 | 4 | database | open (?:data commons open )?database L(?: <1.0>)?
odc-by-1.0 | 3 | odc | SPDX odc by 1 0
odc-by-1.0 | 4 | commons | open data commons attribution L(?: <1.0>)?
pddl-1.0 | 3 | pddl | SPDX pddl 1 0
pddl-1.0 | 4 | commons | open data commons public domain dedication(?: and| )? ?L
cdla-permissive-2.0 | 3 | cdla | SPDX cdla permissive 2 0
cdla-permissive-2.0 | 4 | community | community data L agreement permissive <2>
cdla-sharing-1.0 | 3 | cdla | SPDX cdla sharing 1 0
cdla-sharing-1.0 | 4 | community | community data L agreement sharing <1.0>
openrail | 4 | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: L)?
upl-1.0 | 3 | upl | SPDX upl 1 0
upl-1.0 | 4 | permissive | universal permissive L(?: <1.0>)?
vim | 3 | vim | SPDX vim
vim | 5 | vim | (?:the )?vim L
beerware | 1 | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
beerware | 3 | beerware | SPDX beerware
beerware | 5 | beerware | (?:the )?beerware L
json | 1 | evil | the software shall be used for good not evil
mulanpsl-2.0 | 3 | mulanpsl | SPDX mulanpsl 2 0
mulanpsl-2.0 | 4 | mulan | mulan (?:psl|permissive software L) <2>
blueoak-1.0.0 | 3 | blueoak | SPDX blueoak 1 0 0
blueoak-1.0.0 | 4 | oak | blue oak model L(?: 1 0 0)?
cecill-2.1 | 3 | cecill | SPDX cecill 2 1
cecill-b | 3 | cecill | SPDX cecill b
cecill-c | 3 | cecill | SPDX cecill c
cecill | 5 | cecill | (?:the )?cecill(?: 2 1| b| c)? L
proprietary | 2 | reserved | (?:copyright|c) (?:[^ ]+ ){1,8}?all rights reserved
proprietary | 2 | confidential | this (?:software|document|file|source code) (?:is|contains) (?:the )?(?:confidential|proprietary and confidential|confidential and proprietary) (?:information|property)
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    expression: re.Pattern[bytes]


def _expand(text: str) -> str:
    def version(m: re.Match) -> str:
        major, _, minor = m[1].partition(".")
        return rf"(?:v ?|ver(?:sion)? |)(?:{major} {minor})" if minor else rf"(?:v ?|ver(?:sion)? |)(?:{major}(?: 0)?)"

    out = re.sub(r"<(\d+(?:\.\d+)?)>", version, text)
    out = re.sub(r"(?<![A-Za-z])L(?![A-Za-z])", "(?:licen[cs]e)", out)
    out = re.sub(r"(?<![A-Za-z])D(?![A-Za-z])", "(?:(?:re)?licen[cs]ed|released|distributed|published|available)", out)
    return out.replace("SPDX", "spdx licen[cs]e identifier").replace(" *", "(?: [^ ]+){0,12}?")


def parse(table: str) -> list[Rule]:
    """Rules in their order; a line that is not of four parts is an error."""
    rules = []
    for line in filter(None, map(str.strip, table.splitlines())):
        label, priority, keyword, expression = line.split(" | ", 3)
        rules.append(Rule(label, int(priority), keyword.encode(), re.compile(rf"(?<![^ ])(?:{_expand(expression)})(?![^ ])".encode())))
    return rules


RULES = parse(TABLE)
