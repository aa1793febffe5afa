"""Signatures of licences, written for lower-case words that stand one space apart.

Punctuation is gone by then: "Apache-2.0" reads "apache 2 0", "(c)" reads "c". All words of one of a
rule's ``gates`` (set apart by commas) must be in a text before its pattern is tried; every text that a
pattern matches passes. Each licence has its name as a pattern and its
identifier as a pattern; FORMS put them into the sentences that grant a licence or tag a file. TEXTS
are sentences of the licences themselves, of notices and of terms. BASE are phrases that are always
reported. Rules are in order: kinds by priority, then as written.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple


class Rule(NamedTuple):
    """``priority`` 0 is the strongest; ``base`` finds are never suppressed."""

    label: str
    kind: str
    priority: int
    weight: float
    gates: tuple[frozenset[str], ...]
    pattern: str
    base: bool = False


#: Phrases that are always reported, whatever covers them.
BASE = """
mit :: mit license :: under the mit license
apache-2 :: apache license version :: apache license version 2
cc-by-nc :: cc by nc :: cc by nc
"""

#: Label, gate words, name, identifier.
LICENSES = """
mit :: mit :: mit(?: expat| x11| style)? licen[cs]e :: mit
mit-0 :: mit :: mit no attribution(?: licen[cs]e)? :: mit 0
x11 :: x11 :: x11 licen[cs]e :: x11
isc :: isc, consortium :: isc licen[cs]e|internet (?:systems|software) consortium licen[cs]e :: isc
apache-2 :: apache, asl :: apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?|asl 2(?: 0)? :: apache 2(?: 0)?
apache-1.1 :: apache :: apache(?: software)? licen[cs]e(?: version| v)? ?1 1 :: apache 1 1
apache-1.0 :: apache :: apache(?: software)? licen[cs]e(?: version| v)? ?1 0 :: apache 1 0
bsd-2-clause :: bsd, freebsd :: (?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)? :: bsd 2 clause
bsd-3-clause :: bsd :: (?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)? :: bsd 3 clause
bsd-4-clause :: bsd :: (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd|old bsd)(?: licen[cs]e)? :: bsd 4 clause
bsd-0-clause :: bsd, 0bsd :: (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)? :: 0bsd
bsd-3-clause-clear :: bsd clear :: bsd 3 clause clear licen[cs]e|clear bsd licen[cs]e :: bsd 3 clause clear
bsd-1-clause :: bsd :: bsd 1 clause(?: licen[cs]e)? :: bsd 1 clause
bsd-patent :: bsd patent :: bsd 2 clause plus patent(?: licen[cs]e)? :: bsd 2 clause patent
gpl-1 :: gnu :: gnu (?:gpl|general public licen[cs]e)(?: version| v)? ?1(?: 0)? :: gpl 1 0(?: only| or later)?
gpl-2 :: gpl, gpl2, general :: (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?2(?: 0)?(?: or (?:any )?later)? :: gpl 2 0(?: only| or later)?
gpl-2 :: gplv2 :: (?:gnu )?gplv2(?: or later)? :: gplv2
gpl-3 :: gpl, gpl3, general :: (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?3(?: 0)?(?: or (?:any )?later)? :: gpl 3 0(?: only| or later)?
gpl-3 :: gplv3 :: (?:gnu )?gplv3(?: or later)? :: gplv3
gpl :: gnu :: gnu (?:gpl|general public licen[cs]e) :: gpl
lgpl-2 :: library :: (?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)? :: lgpl 2 0(?: only| or later)?
lgpl-2.1 :: lgpl, lgpl2, lesser :: (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?2 1(?: or (?:any )?later)? :: lgpl 2 1(?: only| or later)?
lgpl-2.1 :: lgplv2 :: (?:gnu )?lgplv2(?: 1)? :: lgplv2(?: 1)?
lgpl-3 :: lgpl, lgpl3, lesser :: (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?3(?: 0)?(?: or (?:any )?later)? :: lgpl 3 0(?: only| or later)?
lgpl-3 :: lgplv3 :: (?:gnu )?lgplv3 :: lgplv3
lgpl :: lesser :: (?:gnu )?lesser general public licen[cs]e :: lgpl
agpl-3 :: affero :: (?:gnu )?affero (?:gpl|general public licen[cs]e)(?: version| v)? ?3(?: 0)? :: agpl 3 0(?: only| or later)?
agpl-3 :: agplv3 :: (?:gnu )?agplv3 :: agplv3
agpl :: affero :: (?:gnu )?affero general public licen[cs]e :: agpl
gfdl-1.3 :: documentation :: gnu free documentation licen[cs]e(?: version| v)? ?1 3 :: gfdl 1 3(?: only| or later)?
gfdl-1.2 :: documentation :: gnu free documentation licen[cs]e(?: version| v)? ?1 2 :: gfdl 1 2(?: only| or later)?
gfdl :: documentation :: gnu free documentation licen[cs]e :: gfdl
mpl-2 :: mozilla :: mozilla public licen[cs]e(?: version| v)? ?2(?: 0)? :: mpl 2 0
mpl-1.1 :: mozilla :: mozilla public licen[cs]e(?: version| v)? ?1 1 :: mpl 1 1
mpl :: mozilla :: mozilla public licen[cs]e :: mpl
epl-2 :: eclipse :: eclipse public licen[cs]e(?: version| v)? ?2(?: 0)? :: epl 2 0
epl-1 :: eclipse :: eclipse public licen[cs]e(?: version| v)? ?1(?: 0)? :: epl 1 0
epl :: eclipse :: eclipse public licen[cs]e :: epl
edl-1 :: eclipse distribution :: eclipse distribution licen[cs]e(?: version| v)? ?1(?: 0)? :: edl 1 0
cddl-1.0 :: distribution :: common development and distribution licen[cs]e(?: version| v)? ?1 0 :: cddl 1 0
cddl-1.1 :: distribution :: common development and distribution licen[cs]e(?: version| v)? ?1 1 :: cddl 1 1
cddl :: distribution :: common development and distribution licen[cs]e :: cddl
cpl-1 :: common :: common public licen[cs]e(?: version| v)? ?1 0 :: cpl 1 0
ipl-1 :: ibm :: ibm public licen[cs]e(?: version| v)? ?1 0 :: ipl 1 0
eupl-1.2 :: european :: european union public licen[cs]e(?: version| v)? ?1 2 :: eupl 1 2
eupl-1.1 :: european :: european union public licen[cs]e(?: version| v)? ?1 1 :: eupl 1 1
eupl :: european :: european union public licen[cs]e :: eupl
osl-3 :: open software :: open software licen[cs]e(?: version| v)? ?3 0 :: osl 3 0
afl-3 :: academic :: academic free licen[cs]e(?: version| v)? ?3 0 :: afl 3 0
artistic-2 :: artistic :: artistic licen[cs]e(?: version| v)? ?2 0 :: artistic 2 0
artistic-1 :: artistic :: artistic licen[cs]e(?: version| v)? ?1 0 :: artistic 1 0
artistic :: artistic :: (?:perl )?artistic licen[cs]e :: artistic
bsl-1.0 :: boost :: boost software licen[cs]e(?: version| v)?(?: 1 0)? :: bsl 1 0
busl-1.1 :: business source :: business source licen[cs]e(?: version| v)?(?: 1 1)? :: busl 1 1
sspl-1 :: server side :: server side public licen[cs]e(?: version| v)?(?: 1)? :: sspl 1 0
elastic-2 :: elastic :: elastic licen[cs]e(?: version| v)? ?2(?: 0)? :: elastic 2 0
polyform-noncommercial :: polyform noncommercial :: polyform noncommercial licen[cs]e(?: 1 0 0)? :: polyform noncommercial 1 0 0
polyform-small-business :: polyform small :: polyform small business licen[cs]e(?: 1 0 0)? :: polyform small business 1 0 0
unlicense :: unlicense :: the unlicense :: unlicense
wtfpl :: wtfpl :: wtfpl(?: version 2| v2)? :: wtfpl
zlib :: zlib :: zlib(?: libpng)? licen[cs]e :: zlib
libpng :: libpng, png :: (?:png reference library|libpng) licen[cs]e(?: version 2)? :: libpng(?: 2 0)?
curl :: curl :: curl licen[cs]e :: curl
openssl :: openssl :: openssl licen[cs]e|openssl ssleay licen[cs]e :: openssl
python-2 :: python, psf :: python software foundation licen[cs]e(?: version 2)?|psf licen[cs]e(?: agreement)? :: (?:psf|python) 2 0
ruby :: ruby :: ruby licen[cs]e|ruby s licen[cs]e :: ruby
php-3 :: php :: php licen[cs]e(?: version| v)? ?3 01? :: php 3 01?
postgresql :: postgresql :: postgresql licen[cs]e :: postgresql
unicode :: unicode :: unicode (?:licen[cs]e(?: agreement)?|data files and software licen[cs]e)(?: v3)? :: unicode (?:dfs 2016|3 0|tou)
w3c :: w3c :: w3c software(?: and document)?(?: notice and)? licen[cs]e :: w3c(?: 20150513)?
ofl-1.1 :: font :: sil open font licen[cs]e(?: version| v)?(?: 1 1)? :: ofl 1 1
ms-pl :: microsoft, ms :: microsoft public licen[cs]e|ms pl :: ms pl
ms-rl :: microsoft, ms :: microsoft reciprocal licen[cs]e|ms rl :: ms rl
upl-1 :: universal :: universal permissive licen[cs]e(?: version| v)?(?: 1 0)? :: upl 1 0
ncsa :: illinois :: university of illinois ncsa open source licen[cs]e :: ncsa
ecl-2 :: educational :: educational community licen[cs]e(?: version| v)?(?: 2 0)? :: ecl 2 0
vim :: vim :: vim licen[cs]e :: vim
beerware :: beer :: (?:the )?beer ware licen[cs]e(?: revision 42)? :: beerware
qpl-1 :: q :: q public licen[cs]e(?: version| v)?(?: 1 0)? :: qpl 1 0
sleepycat :: sleepycat :: sleepycat licen[cs]e :: sleepycat
zpl-2.1 :: zope :: zope public licen[cs]e(?: version| v)?(?: 2 1)? :: zpl 2 1
mulan-psl-2 :: mulan :: mulan psl v2|mulan permissive software licen[cs]e(?: version 2)? :: mulanpsl 2 0
cecill-2.1 :: cecill :: cecill(?: free software)? licen[cs]e(?: agreement)?(?: version| v)?(?: 2 1)? :: cecill 2 1
cecill-b :: cecill b :: cecill b(?: licen[cs]e)? :: cecill b
hippocratic :: hippocratic :: hippocratic licen[cs]e(?: version| v)?(?: 2 1| 3 0)? :: hippocratic 2 1
blueoak-1 :: oak :: blue oak model licen[cs]e(?: 1 0 0)? :: blueoak 1 0 0
llama :: llama :: llama [23](?: [1-4])? community licen[cs]e(?: agreement)? :: llama[23](?: [1-4])?
rail :: rail, openrail :: (?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)? :: openrail(?: m)?
gemma :: gemma :: gemma terms of use|gemma licen[cs]e :: gemma
cc0 :: zero :: cc zero|creative commons zero(?: v1 0| 1 0)?(?: universal)? :: cc0 1 0
cc0 :: cc0 :: cc0(?: 1 0)?(?: universal)?(?: licen[cs]e)? :: cc0(?: 1 0)?
cc-by-4 :: attribution 4 :: creative commons attribution 4 0(?: international)?(?: licen[cs]e)? :: cc by 4 0
cc-by-3 :: attribution 3 :: creative commons attribution 3 0(?: unported)?(?: licen[cs]e)? :: cc by 3 0
cc-by-2 :: attribution 2 :: creative commons attribution 2 [05](?: generic)?(?: licen[cs]e)? :: cc by 2 [05]
cc-by :: attribution :: creative commons attribution licen[cs]e|cc attribution :: cc by
cc-by-sa-4 :: 4 :: creative commons attribution share ?alike 4 0(?: international)?(?: licen[cs]e)? :: cc by sa 4 0
cc-by-sa-3 :: 3 :: creative commons attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)? :: cc by sa 3 0
cc-by-sa :: creative :: creative commons attribution share ?alike(?: licen[cs]e)? :: cc by sa
cc-by-nd-4 :: 4 :: creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[cs]e)? :: cc by nd 4 0
cc-by-nd :: creative :: creative commons attribution no ?deriv(?:ative)?s(?: licen[cs]e)? :: cc by nd
cc-by-nc-4 :: 4 :: creative commons attribution non ?commercial 4 0(?: international)?(?: licen[cs]e)? :: cc by nc 4 0
cc-by-nc-3 :: 3 :: creative commons attribution non ?commercial 3 0(?: unported)?(?: licen[cs]e)? :: cc by nc 3 0
cc-by-nc :: creative :: creative commons attribution non ?commercial(?: licen[cs]e)? :: cc by nc
cc-by-nc-sa-4 :: 4 :: creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[cs]e)? :: cc by nc sa 4 0
cc-by-nc-sa :: creative :: creative commons attribution non ?commercial share ?alike(?: licen[cs]e)? :: cc by nc sa
cc-by-nc-nd-4 :: 4 :: creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[cs]e)? :: cc by nc nd 4 0
cc-by-nc-nd :: creative :: creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[cs]e)? :: cc by nc nd
odbl-1 :: open database :: open (?:data commons open )?database licen[cs]e(?: version| v)?(?: 1 0)? :: odbl 1 0
odc-by-1 :: commons attribution :: open data commons attribution licen[cs]e(?: version| v)?(?: 1 0)? :: odc by 1 0
pddl-1 :: dedication :: (?:open data commons )?public domain dedication and licen[cs]e(?: version| v)?(?: 1 0)? :: pddl 1 0
ogl-3 :: open government :: open government licen[cs]e(?: version| v)?(?: 3 0)? :: ogl uk 3 0
dl-de-by-2 :: datenlizenz :: datenlizenz deutschland namensnennung(?: version)? 2 0 :: dl de by 2 0
etalab-2 :: ouverte :: licence ouverte(?: version)?(?: 2 0)? :: etalab 2 0
cdla-permissive-2 :: community data :: community data licen[cs]e agreement permissive(?: version)?(?: 2 0)? :: cdla permissive 2 0
cdla-sharing-1 :: community data :: community data licen[cs]e agreement sharing(?: version)?(?: 1 0)? :: cdla sharing 1 0
"""

#: Kind, priority, weight, gate words beside the licence's own, what of the licence it takes, sentence.
FORMS = """
tag :: 1 :: 0.95 :: spdx :: id :: spdx licen[cs]e identifier {}(?: and [^ ]+| or [^ ]+)?
grant :: 2 :: 0.9 :: under :: name :: (?:(?:is|are|was|be|and|made|work|works|code|software|content) )?(?:licen[cs]ed|released|distributed|available|published|provided|shared|covered|redistributed|offered|used) under (?:the |a |an )?(?:terms (?:and conditions )?of (?:the |a )?)?(?:{})
name :: 3 :: 0.7 :: :: name :: (?:{})
"""

#: Label, priority, weight, gate words, sentence.
TEXTS = """
mit :: 0 :: 1.0 :: hereby charge person :: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
mit :: 0 :: 0.9 :: substantial portions :: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit :: 0 :: 0.7 :: merchantability noninfringement :: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit :: 1 :: 0.8 :: mit copyright :: mit licen[cs]e copyright(?: c)? (?:19|20)[0-9][0-9]
mit :: 3 :: 0.7 :: mit :: mit licen[cs]ed
mit :: 2 :: 0.9 :: opensource mit :: opensource org licenses? mit
mit :: 3 :: 0.7 :: expat :: expat licen[cs]e
isc :: 0 :: 1.0 :: hereby fee :: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc :: 0 :: 0.6 :: disclaims author :: the software is provided as is and the author disclaims all warranties with regard to this software
bsd :: 0 :: 0.8 :: redistribution binary :: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd :: 0 :: 0.8 :: redistributions retain :: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd :: 0 :: 0.8 :: redistributions reproduce :: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause :: 0 :: 1.0 :: neither endorse :: neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software
bsd-4-clause :: 0 :: 1.0 :: advertising materials :: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd :: 3 :: 0.6 :: bsd :: bsd (?:style )?licen[cs]e|bsd licen[cs]ed
apache-2 :: 0 :: 1.0 :: apache compliance :: licensed under the apache license version 2 0(?: the license)? you may not use this (?:file|work) except in compliance with the license
apache-2 :: 0 :: 0.9 :: apache licenses :: (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2 :: 0 :: 0.8 :: unless basis :: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 :: 0 :: 0.9 :: contributor perpetual :: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 :: 3 :: 0.7 :: apache2 :: apache2(?: licen[cs]e)?
apache :: 4 :: 0.5 :: apache :: apache(?: software)? licen[cs]e
gpl-2 :: 0 :: 1.0 :: redistribute 2 :: you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?
gpl-3 :: 0 :: 1.0 :: redistribute 3 :: you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
gpl :: 0 :: 0.8 :: gnu received :: you should have received a copy of the gnu general public license along with this (?:program|software|library|file)
gpl :: 0 :: 0.7 :: hope useful :: this program is distributed in the hope that it will be useful but without any warranty
gpl-3 :: 0 :: 0.9 :: copyleft gnu :: the gnu general public license is a free copyleft license for software and other kinds of works
gpl :: 2 :: 0.8 :: gnu licenses :: (?:www )?gnu org licenses gpl(?: [23] 0)?(?: html| txt)?
gpl :: 4 :: 0.5 :: gpl, gpled :: gpl(?:ed)?(?: licen[cs]ed?)?
lgpl-2.1 :: 0 :: 1.0 :: redistribute lesser :: you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3 :: 0 :: 1.0 :: redistribute lesser :: you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl :: 2 :: 0.8 :: gnu licenses :: (?:www )?gnu org licenses lgpl(?: 2 1| 3 0)?(?: html| txt)?
lgpl :: 4 :: 0.5 :: lgpl :: lgpl(?: licen[cs]ed?)?
agpl-3 :: 0 :: 1.0 :: affero published :: under the terms of the gnu affero general public license as published by the free software foundation either version 3
agpl :: 2 :: 0.8 :: gnu licenses :: (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
agpl :: 4 :: 0.5 :: agpl :: agpl(?: licen[cs]ed?)?
gfdl :: 0 :: 1.0 :: permission documentation :: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl :: 1 :: 0.8 :: invariant cover :: with no invariant sections no front cover texts and no back cover texts
mpl-2 :: 0 :: 1.0 :: mozilla subject :: this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 :: 0 :: 0.9 :: mozilla obtain :: if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?mozilla org mpl 2 0
mpl-1.1 :: 0 :: 1.0 :: mozilla contents :: the contents of this file are subject to the mozilla public license version 1 1
mpl :: 2 :: 0.8 :: mozilla mpl :: (?:www )?mozilla org mpl
epl-1 :: 0 :: 1.0 :: eclipse accompanies :: this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution
epl-2 :: 0 :: 1.0 :: eclipse accompanying :: this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl :: 2 :: 0.8 :: eclipse legal :: (?:www )?eclipse org legal epl(?: v10| v20| 2 0)?(?: html)?
cddl :: 0 :: 1.0 :: contents distribution :: the contents of this file are subject to the terms of the common development and distribution license
bsl-1.0 :: 0 :: 1.0 :: boost distributed :: distributed under the boost software license version 1 0
bsl-1.0 :: 0 :: 0.9 :: boost license :: (?:www )?boost org license 1 0 txt
unlicense :: 0 :: 1.0 :: unencumbered domain :: this is free and unencumbered software released into the public domain
unlicense :: 2 :: 0.9 :: unlicense :: (?:www )?unlicense org
wtfpl :: 0 :: 1.0 :: fuck public :: do what the fuck you want to public license
wtfpl :: 2 :: 0.9 :: wtfpl net :: (?:www )?wtfpl net
zlib :: 0 :: 1.0 :: misrepresented origin :: the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib :: 0 :: 0.9 :: altered plainly :: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
openssl :: 0 :: 1.0 :: openssl toolkit :: this product includes software developed by the openssl project for use in the openssl toolkit
ofl-1.1 :: 0 :: 1.0 :: font sil :: this font software is licensed under the sil open font license version 1 1
ofl-1.1 :: 2 :: 0.9 :: scripts ofl :: scripts sil org ofl
unicode :: 0 :: 1.0 :: unicode hereby :: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
python-2 :: 0 :: 1.0 :: psf hereby :: psf hereby grants licensee a nonexclusive royalty free world wide license
w3c :: 0 :: 1.0 :: obtaining licensee :: by obtaining and or copying this work you the licensee agree that you have read understood and will comply with
beerware :: 0 :: 1.0 :: beer meet :: if we meet some day and you think this stuff is worth it you can buy me a beer in return
ncsa :: 0 :: 1.0 :: illinois developed :: developed by (?:[^ ]+ ){1,8}university of illinois
ms-pl :: 0 :: 0.9 :: governs accompanying :: this license governs use of the accompanying software if you use the software you accept this license
cc0 :: 0 :: 1.0 :: waived extent :: to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighboring rights
cc0 :: 2 :: 0.9 :: publicdomain zero :: creativecommons org publicdomain zero 1 0
cc-pdm :: 2 :: 0.9 :: publicdomain mark :: creativecommons org publicdomain mark 1 0
cc-by :: 2 :: 0.9 :: creativecommons by :: creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa :: 2 :: 0.9 :: creativecommons sa :: creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nd :: 2 :: 0.9 :: creativecommons nd :: creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc :: 2 :: 0.9 :: creativecommons nc :: creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nc-sa :: 2 :: 0.9 :: creativecommons nc sa :: creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd :: 2 :: 0.9 :: creativecommons nc nd :: creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by :: 3 :: 0.7 :: cc by :: cc by(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-sa :: 3 :: 0.8 :: cc sa :: cc by sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nd :: 3 :: 0.8 :: cc nd :: cc by nd(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-sa :: 3 :: 0.8 :: cc nc sa :: cc by nc sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-nd :: 3 :: 0.8 :: cc nc nd :: cc by nc nd(?: [1-4] [05])?(?: licen[cs]e)?
cc :: 4 :: 0.5 :: creative commons :: creative commons(?: public)?(?: licen[cs]e)?
cc-by-4 :: 0 :: 0.9 :: appropriate credit :: you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-nc :: 1 :: 0.8 :: material commercial :: you may not use the material for commercial purposes
cc-by-nd :: 1 :: 0.8 :: remix distribute :: if you remix transform or build upon the material you may not distribute the modified material
cc-by-sa :: 1 :: 0.8 :: remix contributions :: if you remix transform or build upon the material you must distribute your contributions under the same license as the original
odbl-1 :: 2 :: 0.9 :: opendatacommons odbl :: opendatacommons org licenses odbl(?: 1 0)?
odc-by-1 :: 2 :: 0.9 :: opendatacommons by :: opendatacommons org licenses by(?: 1 0)?
pddl-1 :: 2 :: 0.9 :: opendatacommons pddl :: opendatacommons org licenses pddl(?: 1 0)?
ogl-3 :: 0 :: 0.9 :: government sector :: contains public sector information licen[cs]ed under the open government licen[cs]e(?: v3 0| v2 0)?
public-domain :: 2 :: 0.8 :: domain public :: (?:is |are |has been |have been )?(?:hereby )?(?:dedicated to|placed in|released (?:in)?to) the public domain
public-domain :: 3 :: 0.6 :: domain :: (?:is|are) (?:in|part of) the public domain
public-domain :: 3 :: 0.6 :: domain released :: released (?:in)?to the public domain
public-domain :: 2 :: 0.8 :: copyright united states :: not subject to copyright (?:protection )?in the united states
free-restricted :: 2 :: 0.7 :: non use :: (?:free )?for (?:personal and )?non commercial use only
free-restricted :: 2 :: 0.7 :: noncommercial use :: (?:free )?for noncommercial use only
free-restricted :: 2 :: 0.7 :: personal use :: for personal use only
free-restricted :: 2 :: 0.7 :: purposes only :: for (?:academic|research)(?: and (?:academic|research|educational))? purposes only
free-restricted :: 2 :: 0.7 :: evaluation :: for evaluation (?:purposes|use) only
proprietary :: 1 :: 0.8 :: prohibited :: unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: (?:of|or|and|via) [^ ]+){0,6} (?:[^ ]+ ){0,6}(?:is )?(?:strictly )?prohibited
proprietary :: 1 :: 0.8 :: proprietary confidential :: proprietary and confidential|confidential and proprietary
proprietary :: 3 :: 0.6 :: rights reserved :: (?:copyright(?: c)?(?: (?:19|20)[0-9][0-9])?(?: [^ ]+){0,6} )?all rights reserved
proprietary :: 1 :: 0.8 :: without consent, without permission :: (?:may not|must not|cannot) be (?:reproduced|copied|republished|redistributed)(?: [^ ]+){0,12} without (?:the )?(?:prior |express |written )*(?:consent|permission)
proprietary :: 2 :: 0.7 :: part reproduced :: no part of this (?:publication|document|work|book|site|page) may be reproduced
proprietary :: 2 :: 0.7 :: end user agreement :: end user licen[cs]e agreement
proprietary :: 2 :: 0.7 :: commercial licen[cs]e :: (?:requires|purchase) a commercial licen[cs]e
proprietary :: 3 :: 0.5 :: tous droits :: tous droits r[^ ]+serv[^ ]+s
proprietary :: 3 :: 0.5 :: alle rechte :: alle rechte vorbehalten
proprietary :: 3 :: 0.5 :: todos derechos :: todos los derechos reservados
no-training :: 1 :: 0.8 :: train, training :: (?:may not|must not|cannot|shall not) be used (?:to|for) (?:train|training)(?: [^ ]+){0,8} (?:models?|intelligence|ai|systems?)
no-training :: 1 :: 0.8 :: mining :: text and data mining(?: [^ ]+){0,6} (?:is |are )?(?:reserved|prohibited)
warranty-disclaimer :: 1 :: 0.4 :: kind warranty, kind warranties :: as is without warrant(?:y|ies) of any kind
warranty-disclaimer :: 1 :: 0.4 :: event liable :: in no event shall the (?:[^ ]+ ){1,8}be liable for any (?:[^ ]+ ){0,4}(?:claim|damages)
patent-grant :: 1 :: 0.4 :: patent perpetual :: perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent license
copyright-notice :: 4 :: 0.2 :: copyright :: copyright(?: c| copr)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
unknown-license :: 4 :: 0.3 :: under license, under licence :: licen[cs]ed under (?:the |a )?[^ ]+(?: [^ ]+){0,3}? licen[cs]e
unknown-license :: 4 :: 0.3 :: see license, see licence :: see (?:the )?(?:accompanying |file )?licen[cs]e(?: file| txt| md)?(?: for (?:details|more|terms))
unknown-license :: 4 :: 0.3 :: terms license, terms licence :: subject to the terms of (?:the|a|an) [^ ]+(?: [^ ]+){0,3}? licen[cs]e
"""


def _lines(table: str) -> list[list[str]]:
    return [[f.strip() for f in line.split("::")] for line in table.strip().splitlines()]


def _gates(*fields: str) -> tuple[frozenset[str], ...]:
    """Every choice of one gate from each field; a word with letters to choose from is no gate."""
    each = [[frozenset(w for w in g.split() if w.isalnum()) for g in field.split(",")] for field in fields]
    return tuple(frozenset().union(*choice) for choice in product(*each))


def rules() -> list[Rule]:
    """All rules by priority, then as written."""
    out = [Rule(label, "base", 0, 1.0, _gates(gate), pattern, True) for label, gate, pattern in _lines(BASE)]
    out += [Rule(label, "text", int(p), float(w), _gates(gate), pattern) for label, p, w, gate, pattern in _lines(TEXTS)]
    for kind, p, w, gate, takes, sentence in _lines(FORMS):
        for label, own, name, tag in _lines(LICENSES):
            # A licence's gates are those of its name; a tag is gated by its own sentence alone.
            gates = _gates(gate) if takes == "id" else _gates(gate, own)
            out.append(Rule(label, kind, int(p), float(w), gates, sentence.format(tag if takes == "id" else name)))
    return sorted(out, key=lambda r: r.priority)
