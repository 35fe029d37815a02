"""The license signatures, in order: label; priority; keyword; regex over words.

A regex is written over lower-case words with one space between; it has to
cover whole words. Its keyword is a string that every match holds inside one
word. Priorities: 9 declared identifiers, 8 versioned titles, 7 grants with a
version, 6 titles, 5 characteristic sentences, 4 short names, 3 hints.
"""

from __future__ import annotations

#: Identifiers of the public SPDX list, for lines such as "SPDX-License-Identifier: MIT".
IDENTIFIERS = """
0BSD AAL AFL-1.1 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later
APSL-1.0 APSL-2.0 Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0
BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause
BSL-1.0 BUSL-1.1 BlueOak-1.0.0 CAL-1.0 CATOSL-1.1 CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0
CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-2.0 CDLA-Sharing-1.0
CECILL-2.1 CECILL-B CECILL-C CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CPAL-1.0 CPL-1.0 CUA-OPL-1.0
ECL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 Elastic-2.0 Entessa FSFAP FTL Fair
GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later
HPND ICU IJG IPA IPL-1.0 ISC JSON Jam LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later
LPL-1.02 LPPL-1.3c LiLiQ-P-1.1 Libpng MIT MIT-0 MIT-Modern-Variant MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MirOS Motosoto MulanPSL-2.0 Multics
NASA-1.3 NCSA NGPL NPOSL-3.0 NTP Naumen Nokia OCLC-2.0 ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OGTSL OLDAP-2.8 OSET-PL-2.1 OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0
OpenSSL PDDL-1.0 PHP-3.0 PHP-3.01 PSF-2.0 PostgreSQL Python-2.0 QPL-1.0 RPL-1.1 RPL-1.5 RPSL-1.0 RSCPL Ruby
SGI-B-2.0 SISSL SPL-1.0 SSPL-1.0 SimPL-2.0 Sleepycat TCL UCL-1.0 UPL-1.0 Unicode-DFS-2016 Unlicense VSL-1.0 Vim W3C WTFPL Watcom-1.0 Xnet X11 ZPL-2.0 ZPL-2.1 Zend-2.0 Zlib
""".split()

SIGNATURES = """
agpl-3.0-or-later;7;affero;(?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:3|v3)(?: 0)?(?: of the license)? or (?:at your option )?any later version
agpl-3.0;8;affero;(?:gnu )?affero general public license(?: version| v)? (?:3|v3)(?: 0)?
agpl;6;affero;(?:gnu )?affero general public license
agpl-3.0;4;agpl;(?:gnu )?agpl(?: version| v)? (?:3|v3)(?: 0)?
agpl;4;agpl;(?:the )?(?:gnu )?agpl license
lgpl-2.1-or-later;7;lesser;(?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1(?: of the license)? or (?:at your option )?any later version
lgpl-3.0-or-later;7;lesser;(?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?(?: of the license)? or (?:at your option )?any later version
lgpl-2.1;8;lesser;(?:gnu )?lesser general public license(?: version| v)? (?:2|v2) 1
lgpl-3.0;8;lesser;(?:gnu )?lesser general public license(?: version| v)? (?:3|v3)(?: 0)?
lgpl-2.0;8;library;(?:gnu )?library general public license(?: version| v)? (?:2|v2)(?: 0)?
lgpl;6;lesser;(?:gnu )?lesser general public license
lgpl;6;library;(?:gnu )?library general public license
lgpl-2.1;4;lgpl;(?:gnu )?lgpl(?: version| v)? (?:2|v2) 1
lgpl-3.0;4;lgpl;(?:gnu )?lgpl(?: version| v)? (?:3|v3)(?: 0)?
gpl-2.0-or-later;7;general;(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-3.0-or-later;7;general;(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-2.0-only;7;general;(?:gnu )?general public license version 2(?: 0)? only
gpl-3.0-only;7;general;(?:gnu )?general public license version 3(?: 0)? only
gpl-1.0;8;general;(?:gnu )?general public license(?: version| v)? (?:1|v1)(?: 0)?
gpl-2.0;8;general;(?:gnu )?general public license(?: version| v)? (?:2|v2)(?: 0)?
gpl-3.0;8;general;(?:gnu )?general public license(?: version| v)? (?:3|v3)(?: 0)?
gpl;6;general;(?:the )?gnu general public license
gpl;5;general;(?:under|of) the terms of the (?:gnu )?general public license
gpl-2.0;4;gpl;(?:gnu )?gpl(?: version| v)? (?:2|v2)(?: 0)?
gpl-3.0;4;gpl;(?:gnu )?gpl(?: version| v)? (?:3|v3)(?: 0)?
gpl-2.0;4;gplv2;(?:gnu )?gplv2(?: or later)?
gpl-3.0;4;gplv3;(?:gnu )?gplv3(?: or later)?
lgpl-2.1;4;lgplv2;(?:gnu )?lgplv2(?: 1)?
lgpl-3.0;4;lgplv3;(?:gnu )?lgplv3
agpl-3.0;4;agplv3;(?:gnu )?agplv3
gpl;3;gpl;(?:gnu )gpl
gfdl-1.1;8;documentation;(?:gnu )?free documentation license version 1 1
gfdl-1.2;8;documentation;(?:gnu )?free documentation license version 1 2
gfdl-1.3;8;documentation;(?:gnu )?free documentation license version 1 3
gfdl;6;documentation;(?:gnu )?free documentation license
gpl-exception;5;exception;with the classpath exception
gpl-exception;5;exception;gcc runtime library exception
gpl-exception;5;exception;openssl exception
apache-2.0;8;apache;apache (?:software )?license version 2(?: 0)?
apache-2.0;8;apache;apache (?:software )?license 2(?: 0)?
apache-2.0;8;apache;apache (?:software )?license v2(?: 0)?
apache-1.1;8;apache;apache (?:software )?license(?: version| v)? 1 1
apache-1.0;8;apache;apache (?:software )?license(?: version| v)? 1 0
apache-2.0;4;apache;apache 2(?: 0)?(?: license)?
apache-2.0;4;asl;asl 2(?: 0)?
apache;6;apache;(?:the )?apache (?:software )?license
apache-2.0;5;licenses;www apache org licenses license 2 0
apache-2.0;5;contributor;licensed to the apache software foundation asf under one or more contributor license agreements
mit;6;mit;(?:the )?mit license
mit;6;mit;(?:the )?mit x11 license
mit;6;expat;(?:the )?expat license
mit;5;granted;permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit;5;sublicense;to use copy modify merge publish distribute sublicense and or sell copies of the software
mit;5;notice;the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0;6;attribution;mit no attribution(?: license)?
x11;6;x11;(?:the )?x11 license
mit;4;mit;licensed under (?:the )?mit
mit;4;mit;released under (?:the )?mit
isc;6;isc;(?:the )?isc license
isc;5;permission;permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc;4;isc;licensed under (?:the )?isc
bsd-2-clause;8;bsd;(?:the )?(?:simplified )?bsd 2 clause(?: simplified)?(?: license)?
bsd-2-clause;8;bsd;(?:the )?2 clause bsd(?: license)?
bsd-3-clause;8;bsd;(?:the )?bsd 3 clause(?: new)?(?: license)?
bsd-3-clause;8;bsd;(?:the )?3 clause bsd(?: license)?
bsd-4-clause;8;bsd;(?:the )?bsd 4 clause(?: license)?
bsd-4-clause;8;bsd;(?:the )?4 clause bsd(?: license)?
bsd-2-clause;6;bsd;(?:the )?simplified bsd license
bsd-2-clause;6;freebsd;(?:the )?freebsd license
bsd-3-clause;6;bsd;(?:the )?(?:new|revised|modified) bsd license
bsd-4-clause;6;bsd;(?:the )?(?:original|old) bsd license
0bsd;6;bsd;(?:the )?zero clause bsd(?: license)?
0bsd;6;bsd;(?:the )?bsd zero clause(?: license)?
bsd;6;bsd;(?:the )?bsd (?:style )?license
bsd;5;redistribution;redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause;5;endorse;may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause;5;advertising;all advertising materials mentioning features or use of this software must display the following acknowledgement
cc0-1.0;8;cc0;(?:creative commons )?cc0 1 0(?: universal)?
cc0-1.0;6;cc0;(?:creative commons )?cc0(?: license| public domain dedication)?
cc0-1.0;6;zero;creative commons zero
cc-by-nc-nd-4.0;8;noncommercial;(?:creative commons )?attribution noncommercial noderivatives 4 0(?: international)?
cc-by-nc-nd-3.0;8;noncommercial;(?:creative commons )?attribution noncommercial noderivs 3 0(?: unported)?
cc-by-nc-sa-4.0;8;noncommercial;(?:creative commons )?attribution noncommercial sharealike 4 0(?: international)?
cc-by-nc-sa-3.0;8;noncommercial;(?:creative commons )?attribution noncommercial sharealike 3 0(?: unported)?
cc-by-nc-4.0;8;noncommercial;(?:creative commons )?attribution noncommercial 4 0(?: international)?
cc-by-nc-3.0;8;noncommercial;(?:creative commons )?attribution noncommercial 3 0(?: unported)?
cc-by-nd-4.0;8;noderivatives;(?:creative commons )?attribution noderivatives 4 0(?: international)?
cc-by-nd-3.0;8;noderivs;(?:creative commons )?attribution noderivs 3 0(?: unported)?
cc-by-sa-4.0;8;sharealike;(?:creative commons )?attribution sharealike 4 0(?: international)?
cc-by-sa-3.0;8;sharealike;(?:creative commons )?attribution sharealike 3 0(?: unported)?
cc-by-sa-2.5;8;sharealike;(?:creative commons )?attribution sharealike 2 5(?: generic)?
cc-by-4.0;8;attribution;creative commons attribution 4 0(?: international)?
cc-by-3.0;8;attribution;creative commons attribution 3 0(?: unported)?
cc-by-2.5;8;attribution;creative commons attribution 2 5(?: generic)?
cc-by-2.0;8;attribution;creative commons attribution 2 0(?: generic)?
cc-by-nc-nd-4.0;8;cc;cc by nc nd 4 0
cc-by-nc-nd-3.0;8;cc;cc by nc nd 3 0
cc-by-nc-sa-4.0;8;cc;cc by nc sa 4 0
cc-by-nc-sa-3.0;8;cc;cc by nc sa 3 0
cc-by-nc-4.0;8;cc;cc by nc 4 0
cc-by-nc-3.0;8;cc;cc by nc 3 0
cc-by-nd-4.0;8;cc;cc by nd 4 0
cc-by-nd-3.0;8;cc;cc by nd 3 0
cc-by-sa-4.0;8;cc;cc by sa 4 0
cc-by-sa-3.0;8;cc;cc by sa 3 0
cc-by-sa-2.0;8;cc;cc by sa 2 0
cc-by-4.0;8;cc;cc by 4 0
cc-by-3.0;8;cc;cc by 3 0
cc-by-2.0;8;cc;cc by 2 0
cc-by-nc-nd;6;cc;cc by nc nd
cc-by-nc-sa;6;cc;cc by nc sa
cc-by-nc;6;cc;cc by nc
cc-by-nd;6;cc;cc by nd
cc-by-sa;6;cc;cc by sa
cc-by;4;cc;cc by
cc-by-sa;6;sharealike;(?:creative commons )attribution sharealike(?: license)?
cc-by-nc;6;noncommercial;(?:creative commons )attribution noncommercial(?: license)?
cc-by;6;attribution;creative commons attribution(?: license)?
cc;3;commons;(?:a |the )?creative commons license
cc-by-4.0;5;licenses;creativecommons org licenses by 4 0
cc-by-3.0;5;licenses;creativecommons org licenses by 3 0
cc-by-sa-4.0;5;licenses;creativecommons org licenses by sa 4 0
cc-by-sa-3.0;5;licenses;creativecommons org licenses by sa 3 0
cc-by-nc-4.0;5;licenses;creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0;5;licenses;creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0;5;licenses;creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0;5;licenses;creativecommons org licenses by nd 4 0
cc0-1.0;5;publicdomain;creativecommons org publicdomain zero 1 0
mpl-2.0;8;mozilla;mozilla public license(?: version| v)? 2(?: 0)?
mpl-1.1;8;mozilla;mozilla public license(?: version| v)? 1 1
mpl-1.0;8;mozilla;mozilla public license(?: version| v)? 1 0
mpl;6;mozilla;(?:the )?mozilla public license
mpl-2.0;4;mpl;mpl(?: version)? 2(?: 0)?
epl-2.0;8;eclipse;eclipse public license(?: version| v)? 2(?: 0)?
epl-1.0;8;eclipse;eclipse public license(?: version| v)? 1(?: 0)?
epl;6;eclipse;(?:the )?eclipse public license
edl-1.0;6;eclipse;eclipse distribution license(?: v| version)?(?: 1 0)?
eupl-1.2;8;union;european union public licen[cs]e(?: version| v)? 1 2
eupl-1.1;8;union;european union public licen[cs]e(?: version| v)? 1 1
eupl;6;union;european union public licen[cs]e
cddl-1.0;8;distribution;common development and distribution license(?: version)? 1 0
cddl-1.1;8;distribution;common development and distribution license(?: version)? 1 1
cddl;6;distribution;common development and distribution license
cpl-1.0;8;common;common public license(?: version)? 1 0
cpl;6;common;common public license
cpal-1.0;6;attribution;common public attribution license(?: version)?(?: 1 0)?
artistic-2.0;8;artistic;(?:the )?artistic license 2(?: 0)?
artistic-1.0;8;artistic;(?:the )?artistic license 1(?: 0)?
artistic;6;artistic;(?:the )?artistic license
perl;5;perl;under the same terms as perl itself
bsl-1.0;8;boost;boost software license(?: version)? 1 0
bsl-1.0;6;boost;boost software license
zlib;6;zlib;(?:the )?zlib(?: libpng)? license
zlib;5;provided;this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
libpng;6;png;(?:the )?(?:png reference library|libpng) license
unlicense;6;unlicense;(?:the )?unlicense
unlicense;5;unencumbered;this is free and unencumbered software released into the public domain
wtfpl;6;wtfpl;wtfpl(?: version 2)?
wtfpl;6;want;do what the fuck you want to public license
beerware;6;beer;(?:the )?beer ware license
public-domain;5;domain;(?:is |are |placed |released |dedicated )?(?:in|into|to) the public domain
public-domain;3;domain;public domain
ofl-1.1;8;font;sil open font license(?: version| v)? 1 1
ofl-1.0;8;font;sil open font license(?: version| v)? 1 0
ofl;6;font;(?:sil )?open font license
odbl-1.0;8;database;open (?:data commons open )?database license(?: v| version)?(?: 1 0)
odbl;6;database;open (?:data commons open )?database license
odc-by;6;attribution;open data commons attribution license
pddl;6;dedication;open data commons public domain dedication and license
cdla-permissive;6;data;community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing;6;data;community data license agreement sharing(?: version)?(?: 1 0)?
ogl-3.0;8;government;open government licen[cs]e(?: version| v)? (?:3|v3)(?: 0)?
ogl;6;government;open government licen[cs]e
osl-3.0;8;open;open software license(?: version| v)? 3(?: 0)?
osl;6;open;open software license
afl-3.0;8;academic;academic free license(?: version| v)? 3(?: 0)?
afl;6;academic;academic free license
ecl-2.0;8;educational;educational community license(?: version)? 2(?: 0)?
ecl;6;educational;educational community license
ms-pl;6;microsoft;microsoft public license
ms-rl;6;microsoft;microsoft reciprocal license
psf;6;python;python software foundation license(?: version 2)?
python;6;python;(?:the )?python license
php;6;php;(?:the )?php license(?: version)?(?: 3(?: 0[01]?)?)?
ruby;6;ruby;(?:the )?ruby license
ruby;5;ruby;under the same terms as ruby
postgresql;6;postgresql;(?:the )?postgresql licen[cs]e
openssl;6;openssl;(?:the )?openssl license
ssleay;6;ssleay;(?:the )?(?:original )?ssleay license
sleepycat;6;sleepycat;(?:the )?sleepycat license
ncsa;6;ncsa;(?:university of illinois )?ncsa open source license
ntp;6;ntp;(?:the )?ntp license
icu;6;icu;(?:the )?icu license
ijg;6;jpeg;independent jpeg group license
ftl;6;freetype;(?:the )?freetype (?:project )?license
tcl;6;tcl;(?:the )?tcl tk license
vim;6;vim;(?:the )?vim license
json;6;json;(?:the )?json license
json;5;evil;the software shall be used for good not evil
w3c;6;w3c;w3c software (?:notice and )?license
qpl-1.0;6;public;q public license(?: version)?(?: 1 0)?
zpl;6;zope;zope public license(?: version| v)?(?: 2 [01])?
lppl;6;latex;latex project public license(?: version)?(?: 1 3[abc]?)?
cecill;6;cecill;(?:the )?cecill(?: [bc])?(?: free software)? license
upl-1.0;6;universal;universal permissive license(?: version| v)?(?: 1 0)?
mulan-2.0;6;mulan;mulan (?:psl|permissive software license)(?: version| v)?(?: 2| v2)?
blueoak;6;oak;blue oak model license(?: 1 0 0)?
sspl-1.0;6;server;server side public license(?: version| v)?(?: 1)?
busl-1.1;8;business;business source license(?: version)? 1 1
busl;6;business;business source license
elastic-2.0;6;elastic;elastic license(?: version| v)?(?: 2(?: 0)?)?
commons-clause;6;clause;commons clause license condition(?: v1 0)?
polyform;6;polyform;polyform (?:noncommercial|shield|strict|free trial|perimeter|small business)(?: license)?(?: 1 0 0)?
openrail;6;openrail;(?:creativeml |bigscience )?openrail(?: m| d| s)?(?: license)?
rail;6;responsible;responsible ai license(?:s)?
llama;6;llama;llama (?:[23] )?community license(?: agreement)?
hpnd;6;historical;historical permission notice and disclaimer
apsl-2.0;6;apple;apple public source license(?: version)?(?: 2 0)?
npl;6;netscape;netscape public license(?: version)?(?: 1 [01])?
sissl;6;sun;sun industry standards source license
ipl-1.0;6;ibm;ibm public license(?: version)?(?: 1 0)?
nasa-1.3;6;nasa;nasa open source agreement(?: version)?(?: 1 3)?
rpl-1.5;6;reciprocal;reciprocal public license(?: version)?(?: 1 [15])?
cern-ohl;6;hardware;cern open hardware licen[cs]e(?: version)?(?: 2)?(?: strongly reciprocal| weakly reciprocal| permissive)?
solderpad;6;solderpad;solderpad hardware license(?: version)?(?: (?:0 51|2 [01]))?
tapr-ohl;6;tapr;tapr open hardware license
proprietary;5;rights;all rights reserved(?: worldwide)?
proprietary;5;confidential;proprietary and confidential
proprietary;5;license;end user license agreement
proprietary;5;commercial;commercial license(?: agreement)?
proprietary;4;reproduced;no part of this (?:publication|work|book) may be reproduced
proprietary;4;permission;without (?:the )?(?:express |prior )?written permission of the (?:publisher|author|copyright holder)
unknown;3;license;(?:see|read) the license file(?: for details)?
unknown;3;licensed;this (?:work|software|project|file|document|text|content) is licensed under
unknown;3;license;licensed under the terms of
unknown;3;copyright;copyright (?:c )?(?:19|20)[0-9][0-9]
""".strip().splitlines()


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, regex over words), in order; the declared identifiers come first."""
    declared = [(i.lower(), 9, "spdx", "spdx license identifier " + " ".join(i.lower().replace("-", " ").replace(".", " ").split())) for i in IDENTIFIERS]
    return declared + [(a, int(b), c, d) for a, b, c, d in (line.split(";", 3) for line in SIGNATURES)]
