"""Signature rules of licences, written by hand.

A line is: priority, keyword, regex. The regex is tried only in texts that hold the keyword; of
detections that contain one another the one of higher priority stays, of equal priority the longer one. Priority also
says how sure a detection is: 9 a tag, 8 an address, 7 a full name with version, 6 a full name, 5 a
sentence of the licence's text, 4 a short name, 3 a loose mention. Regexes meet lower-cased text;
a blank stands for any run of white space, quotes, commas, comment marks and dashes.
"""

from __future__ import annotations

RULES_TEXT = r"""
= gpl-1.0
9 spdx spdx license identifier: gpl-1\.0(-only|-or-later|\+)?
7 general public gnu (general public license|gpl),? (version|v\.?) ?1(\.0)?\b
= gpl-2.0
9 spdx spdx license identifier: gpl-2\.0(-only|-or-later|\+)?
8 gnu.org gnu\.org/licenses/(old-licenses/)?gpl-2\.0
8 opensource opensource\.org/licenses?/gpl-2\.0
7 general public gnu general public license,? (as published by the free software foundation[;,]? )?(either )?(version|v\.?) ?2(\.0)?\b
7 gpl \bgnu gpl,? ?(version |v\.? ?)2(\.0)?\b
4 gpl \bgpl[ -]?v?2(\.0)?\b(\+| or later)?
5 activities activities other than copying, distribution and modification are not covered by this license
= gpl-3.0
9 spdx spdx license identifier: gpl-3\.0(-only|-or-later|\+)?
8 gnu.org gnu\.org/licenses/gpl(-3\.0)?(\.html|\.txt|\.en\.html)?\b
8 opensource opensource\.org/licenses?/gpl-3\.0
7 general public gnu general public license,? (as published by the free software foundation[;,]? )?(either )?(version|v\.?) ?3(\.0)?\b
7 gpl \bgnu gpl,? ?(version |v\.? ?)3(\.0)?\b
4 gpl \bgpl[ -]?v?3(\.0)?\b(\+| or later)?
5 copyleft is a free,? copyleft license for software and other kinds of works
= gpl
6 general public \bgnu general public licen[cs]e\b
4 general public \bgeneral public licen[cs]e\b
4 gpl \b(the|under|gnu) gpl\b
3 gpl \bgpl licen[cs]ed?\b
5 redistribute it and/or modify it under the terms of the gnu general public
5 warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
= lgpl-2.0
9 spdx spdx license identifier: lgpl-2\.0(-only|-or-later|\+)?
7 library general gnu library general public license,? (version|v\.?) ?2(\.0)?\b
6 library general \bgnu library general public licen[cs]e\b
= lgpl-2.1
9 spdx spdx license identifier: lgpl-2\.1(-only|-or-later|\+)?
8 gnu.org gnu\.org/licenses/(old-licenses/)?lgpl-2\.1
7 lesser general gnu lesser general public license,? (as published by the free software foundation[;,]? )?(either )?(version|v\.?) ?2\.1\b
4 lgpl \blgpl[ -]?v?2\.1\b(\+| or later)?
= lgpl-3.0
9 spdx spdx license identifier: lgpl-3\.0(-only|-or-later|\+)?
8 gnu.org gnu\.org/licenses/lgpl(-3\.0)?(\.html|\.txt)?\b
7 lesser general gnu lesser general public license,? (as published by the free software foundation[;,]? )?(either )?(version|v\.?) ?3(\.0)?\b
4 lgpl \blgpl[ -]?v?3(\.0)?\b(\+| or later)?
= lgpl
6 lesser general \bgnu lesser general public licen[cs]e\b
4 lesser general \blesser general public licen[cs]e\b
3 lgpl \blgpl\b
= agpl-3.0
9 spdx spdx license identifier: agpl-3\.0(-only|-or-later|\+)?
8 gnu.org gnu\.org/licenses/agpl(-3\.0)?(\.html|\.txt)?\b
7 affero gnu affero general public license,? (as published by the free software foundation[;,]? )?(either )?(version|v\.?) ?3(\.0)?\b
4 agpl \bagpl[ -]?v?3(\.0)?\b(\+| or later)?
5 remote network remote network interaction use with the gnu general public license
= agpl
6 affero \b(gnu )?affero general public licen[cs]e\b
3 agpl \bagpl\b
= gfdl
9 spdx spdx license identifier: gfdl-1\.[123](-only|-or-later)?
8 gnu.org gnu\.org/(copyleft|licenses)/fdl
6 free documentation \bgnu free documentation licen[cs]e\b
4 gfdl \bgfdl\b
5 invariant with no invariant sections,? no front cover texts,? and no back cover texts
= apache-1.1
9 spdx spdx license identifier: apache-1\.[01]
7 apache \bapache (software )?license,? (version|v\.?) ?1\.[01]\b
5 apache software foundation this product includes software developed by the apache software foundation
= apache-2.0
9 spdx spdx license identifier: apache-2\.0
8 apache.org apache\.org/licenses/license-2\.0
8 opensource opensource\.org/licenses?/apache-2\.0
7 apache \b(the )?apache (software )?license,? ?(version|v\.?) ?2(\.0)?\b
7 apache \bapache[ -]2(\.0)? licen[cs]ed?\b
4 apache \bapache[ -]?2\.0\b
5 except in compliance you may not use this file except in compliance with the license
5 as is basis distributed on an as is basis,? without warranties or conditions of any kind
5 perpetual perpetual,? worldwide,? non exclusive,? no charge,? royalty free,? irrevocable copyright license
= apache
6 apache \bapache (software |public )?licen[cs]e\b
3 apache \bapache licen[cs]ed\b
= mit
9 spdx spdx license identifier: mit\b
8 opensource opensource\.org/licenses?/mit\b
8 mit-license mit-license\.org
6 mit \b(the )?mit licen[cs]e\b
6 expat \b(the )?expat licen[cs]e\b
4 mit \b(mit licen[cs]ed|licen[cs]ed? under (the )?mit|licen[cs]e: mit)\b
5 permission is hereby permission is hereby granted,? free of charge,? to any person obtaining a copy
5 substantial portions shall be included in all copies or substantial portions of the software
5 dealings in the from,? out of or in connection with the software or the use or other dealings in the software
= mit-0
9 spdx spdx license identifier: mit-0
6 attribution \bmit no attribution\b
= x11
9 spdx spdx license identifier: x11\b
6 x11 \b(the )?x11 licen[cs]e\b
5 x consortium name of the x consortium shall not be used in advertising
= bsd-0-clause
9 spdx spdx license identifier: 0bsd
6 zero-clause \bzero-clause bsd\b
4 0bsd \b0bsd\b
= bsd-2-clause
9 spdx spdx license identifier: bsd-2-clause(-patent|-views)?
8 opensource opensource\.org/licenses?/bsd-2-clause
7 bsd \b(bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[cs]e\b
4 bsd \bbsd[ -]2([ -]clause)?\b
= bsd-3-clause
9 spdx spdx license identifier: bsd-3-clause(-clear|-lbnl)?
8 opensource opensource\.org/licenses?/bsd-3-clause
7 bsd \b(bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e\b
4 bsd \bbsd[ -]3([ -]clause)?\b
5 endorse neither the name of .{1,120} nor the names of (its|any) contributors may be used to endorse or promote products
= bsd-4-clause
9 spdx spdx license identifier: bsd-4-clause(-uc)?
7 bsd \b(bsd 4 clause|4 clause bsd|original bsd|old bsd) licen[cs]e\b
5 advertising materials all advertising materials mentioning features or use of this software must display
= bsd
8 opensource opensource\.org/licenses?/bsd-license
6 bsd \b(the )?bsd (style )?licen[cs]e\b
3 bsd \bbsd licen[cs]ed\b
5 source and binary redistribution and use in source and binary forms,? with or without modification,? are permitted
5 above copyright redistributions (of source code|in binary form) must (retain|reproduce) the above copyright notice
= isc
9 spdx spdx license identifier: isc\b
8 opensource opensource\.org/licenses?/isc
6 isc \b(the )?isc licen[cs]e\b
5 permission to use permission to use,? copy,? modify,? and(/or)? distribute this software for any purpose with or without fee
= mpl-1.0
9 spdx spdx license identifier: mpl-1\.0
7 mozilla \bmozilla public license,? (version|v\.?) ?1\.0\b
= mpl-1.1
9 spdx spdx license identifier: mpl-1\.1
8 mozilla.org mozilla\.org/mpl/(mpl-)?1\.1
7 mozilla \bmozilla public license,? (version|v\.?) ?1\.1\b
4 mpl \bmpl[ -]?v?1\.1\b
= mpl-2.0
9 spdx spdx license identifier: mpl-2\.0(-no-copyleft-exception)?
8 mozilla.org mozilla\.org/(en-us/)?mpl/2\.0
8 opensource opensource\.org/licenses?/mpl-2\.0
7 mozilla \bmozilla public license,? (version|v\.?|,)? ?2\.0\b
4 mpl \bmpl[ -]?v?2\.0\b
5 source code form this source code form is subject to the terms of the mozilla public license
= mpl
6 mozilla \bmozilla public licen[cs]e\b
= epl-1.0
9 spdx spdx license identifier: epl-1\.0
8 eclipse eclipse\.org/legal/epl-v10
7 eclipse \beclipse public license,? (version|v\.?|-)? ?v?1\.0\b
4 epl \bepl[ -]?v?1\.0\b
= epl-2.0
9 spdx spdx license identifier: epl-2\.0
8 eclipse eclipse\.org/legal/epl-(2\.0|v20)
7 eclipse \beclipse public license,? (version|v\.?|-)? ?v?2\.0\b
4 epl \bepl[ -]?v?2\.0\b
= epl
6 eclipse \beclipse public licen[cs]e\b
= edl-1.0
8 eclipse eclipse\.org/org/documents/edl-v10
6 eclipse \beclipse distribution licen[cs]e\b
= cddl-1.0
9 spdx spdx license identifier: cddl-1\.0
7 common development \bcommon development and distribution license,? \(?(cddl\)?,? )?(version|v\.?) ?1\.0\b
4 cddl \bcddl[ -]?v?1\.0\b
= cddl
6 common development \bcommon development and distribution licen[cs]e\b
3 cddl \bcddl\b
= cpl-1.0
9 spdx spdx license identifier: cpl-1\.0
6 common public \bcommon public licen[cs]e\b
= ipl-1.0
9 spdx spdx license identifier: ipl-1\.0
6 ibm \bibm public licen[cs]e\b
= eupl
9 spdx spdx license identifier: eupl-1\.[012]
8 eupl joinup\.ec\.europa\.eu/.{0,60}eupl
6 european union \beuropean union public licen[cs]e\b
4 eupl \beupl\b
= artistic-1.0
9 spdx spdx license identifier: artistic-1\.0(-perl|-cl8)?
7 artistic \bartistic license,? (version|v\.?)? ?1\.0\b
= artistic-2.0
9 spdx spdx license identifier: artistic-2\.0
8 opensource opensource\.org/licenses?/artistic-license-2\.0
7 artistic \bartistic license,? (version|v\.?)? ?2\.0\b
= artistic
6 artistic \b(the |perl )?artistic licen[cs]e\b
5 perl itself under the same terms as perl( 5)? itself
= boost
9 spdx spdx license identifier: bsl-1\.0
8 boost boost\.org/license_1_0
6 boost \bboost software licen[cs]e\b
5 machine-executable solely in the form of machine executable object code generated by a source language processor
= zlib
9 spdx spdx license identifier: zlib(-acknowledgement)?
8 opensource opensource\.org/licenses?/zlib
6 zlib \b(the )?zlib(/libpng)? licen[cs]e\b
5 misrepresented the origin of this software must not be misrepresented
5 altered source altered source versions must be plainly marked as such
= libpng
9 spdx spdx license identifier: libpng(-2\.0)?
6 libpng \b(the )?(libpng|png reference library) licen[cs]e\b
= ijg
9 spdx spdx license identifier: ijg\b
5 jpeg this software is based in part on the work of the independent jpeg group
= openssl
9 spdx spdx license identifier: openssl
6 openssl \bopenssl licen[cs]e\b
5 openssl this product includes software developed by the openssl project
= curl
9 spdx spdx license identifier: curl\b
6 curl \b(the )?curl licen[cs]e\b
= postgresql
9 spdx spdx license identifier: postgresql
6 postgresql \bpostgresql licen[cs]e\b
= python
9 spdx spdx license identifier: (psf-2\.0|python-2\.0(\.1)?)
6 python \bpython software foundation licen[cs]e\b
4 psf \bpsf licen[cs]e\b
= php-3.0
9 spdx spdx license identifier: php-3\.01?
8 php.net php\.net/license/3_01
6 php \b(the )?php licen[cs]e\b
= ruby
9 spdx spdx license identifier: ruby\b
6 ruby \b(the )?ruby('s)? licen[cs]e\b
= w3c
9 spdx spdx license identifier: w3c(-19980720|-20150513)?
8 w3.org w3\.org/consortium/legal/.{0,60}(software|document)
6 w3c \bw3c (software|document)( notice and)? licen[cs]e\b
= unicode
9 spdx spdx license identifier: unicode-(3\.0|dfs-2015|dfs-2016|tou)
8 unicode.org unicode\.org/(copyright|license)
6 unicode \bunicode(,? inc\.?)? licen[cs]e( agreement)?\b
= ofl-1.1
9 spdx spdx license identifier: ofl-1\.[01](-rfn|-no-rfn)?
8 sil.org (scripts\.sil\.org|openfontlicense\.org)/?(ofl)?
6 font \b(sil )?open font licen[cs]e\b
5 reserved font with reserved font names?
= cc0-1.0
9 spdx spdx license identifier: cc0-1\.0
8 creativecommons creativecommons\.org/publicdomain/zero
7 cc0 \bcc0[ -]?1\.0( universal)?\b
6 cc0 \bcreative commons (zero|cc0)\b
4 cc0 \bcc0\b
= cc-by-nc-nd
9 spdx spdx license identifier: cc-by-nc-nd-[1-4]\.[05]
8 creativecommons creativecommons\.org/licenses/by-nc-nd/
7 noncommercial \battribution non ?commercial no ?deriv(s|atives)\b
4 cc \bcc[ -]by[ -]nc[ -]nd\b( [1-4]\.[05])?
= cc-by-nc-sa
9 spdx spdx license identifier: cc-by-nc-sa-[1-4]\.[05]
8 creativecommons creativecommons\.org/licenses/by-nc-sa/
7 noncommercial \battribution non ?commercial share ?alike\b
4 cc \bcc[ -]by[ -]nc[ -]sa\b( [1-4]\.[05])?
= cc-by-nc
9 spdx spdx license identifier: cc-by-nc-[1-4]\.[05]
8 creativecommons creativecommons\.org/licenses/by-nc/
6 noncommercial \battribution non ?commercial\b
4 cc \bcc[ -]by[ -]nc\b( [1-4]\.[05])?
= cc-by-nd
9 spdx spdx license identifier: cc-by-nd-[1-4]\.[05]
8 creativecommons creativecommons\.org/licenses/by-nd/
6 attribution \battribution no ?deriv(s|atives)\b
4 cc \bcc[ -]by[ -]nd\b( [1-4]\.[05])?
= cc-by-sa
9 spdx spdx license identifier: cc-by-sa-[1-4]\.[05]
8 creativecommons creativecommons\.org/licenses/by-sa/
6 attribution \battribution share ?alike\b
4 cc \bcc[ -]by[ -]sa\b( [1-4]\.[05])?
= cc-by
9 spdx spdx license identifier: cc-by-[1-4]\.[05]
8 creativecommons creativecommons\.org/licenses/by/
6 creative commons \bcreative commons attribution\b( [1-4]\.[05])?
4 cc \bcc[ -]by\b( [1-4]\.[05])?
= cc-pdm
8 creativecommons creativecommons\.org/publicdomain/mark
6 public domain mark \bpublic domain mark\b
= cc
3 creative commons \bcreative commons( licen[cs]e)?\b
8 creativecommons creativecommons\.org/licenses/
= public-domain
6 public domain \b(released|dedicated|placed|put) (in|in ?to|to) the public domain\b
6 public domain \bpublic domain dedication\b
3 public domain \b(is|are) in the public domain\b
= unlicense
9 spdx spdx license identifier: unlicense
8 unlicense unlicense\.org
6 unlicense \bthe unlicense\b
5 unencumbered this is free and unencumbered software released into the public domain
= wtfpl
9 spdx spdx license identifier: wtfpl
8 wtfpl wtfpl\.net
6 public license \bdo what the f[a-z*]{3} you want to public licen[cs]e\b
4 wtfpl \bwtfpl\b
= beerware
9 spdx spdx license identifier: beerware
6 beer \b(the )?beer ?ware licen[cs]e\b
5 buy me a beer you can buy me a beer in return
= odbl-1.0
9 spdx spdx license identifier: odbl-1\.0
8 opendatacommons opendatacommons\.org/licenses/odbl
6 open database \bopen (data commons open )?database licen[cs]e\b
4 odbl \bodbl\b
= odc-by-1.0
9 spdx spdx license identifier: odc-by-1\.0
8 opendatacommons opendatacommons\.org/licenses/by
6 open data commons \bopen data commons attribution licen[cs]e\b
= pddl-1.0
9 spdx spdx license identifier: pddl-1\.0
8 opendatacommons opendatacommons\.org/licenses/pddl
= cdla
9 spdx spdx license identifier: cdla-(permissive|sharing)-[12]\.0
8 cdla cdla\.(dev|io)/(permissive|sharing)
6 community data \bcommunity data licen[cs]e agreement\b
= afl-3.0
9 spdx spdx license identifier: afl-[123]\.[012]
6 academic free \bacademic free licen[cs]e\b
= osl-3.0
9 spdx spdx license identifier: osl-[123]\.[01]
6 open software \bopen software licen[cs]e\b
= ecl-2.0
9 spdx spdx license identifier: ecl-[12]\.0
6 educational community \beducational community licen[cs]e\b
= ncsa
9 spdx spdx license identifier: ncsa\b
6 ncsa \b(university of illinois(/| )ncsa|ncsa) open source licen[cs]e\b
= upl-1.0
9 spdx spdx license identifier: upl-1\.0
6 universal permissive \buniversal permissive licen[cs]e\b
= ms-pl
9 spdx spdx license identifier: ms-pl
6 microsoft public \bmicrosoft public licen[cs]e\b
4 ms-pl \bms-pl\b
= ms-rl
9 spdx spdx license identifier: ms-rl
6 microsoft reciprocal \bmicrosoft reciprocal licen[cs]e\b
= mulan
9 spdx spdx license identifier: mulanpsl-[12]\.0
6 mulan \bmulan (permissive software|psl) ?(licen[cs]e)?,? ?(v[12])?\b
= llvm-exception
9 spdx spdx license identifier: apache-2\.0 with llvm-exception
4 llvm \bllvm exceptions?\b
= classpath-exception
9 spdx spdx license identifier: gpl-2\.0(-only|-or-later|\+)? with classpath-exception-2\.0
4 classpath \bclasspath exception\b
= vim
9 spdx spdx license identifier: vim\b
6 vim \bvim licen[cs]e\b
= tcl
9 spdx spdx license identifier: tcl\b
6 tcl \btcl/tk licen[cs]e\b
= sleepycat
9 spdx spdx license identifier: sleepycat
6 sleepycat \bsleepycat licen[cs]e\b
= qpl-1.0
9 spdx spdx license identifier: qpl-1\.0
6 q public \bq public licen[cs]e\b
= zpl-2.1
9 spdx spdx license identifier: zpl-[12]\.[01]
6 zope \bzope public licen[cs]e\b
= sspl-1.0
9 spdx spdx license identifier: sspl-1\.0
6 server side \bserver side public licen[cs]e\b
4 sspl \bsspl\b
= busl-1.1
9 spdx spdx license identifier: busl-1\.1
6 business source \bbusiness source licen[cs]e\b
5 change date on the change date,? or the fourth anniversary of the first publicly available distribution
= elastic-2.0
9 spdx spdx license identifier: elastic-2\.0
6 elastic \belastic licen[cs]e( 2\.0)?\b
= commons-clause
8 commonsclause commonsclause\.com
6 commons clause \bcommons clause\b( licen[cs]e condition)?
= polyform
9 spdx spdx license identifier: polyform-[a-z-]+-1\.0\.0
8 polyform polyformproject\.org/licenses
6 polyform \bpolyform (noncommercial|small business|strict|shield|perimeter|free trial) licen[cs]e\b
= openrail
6 rail \b(creativeml |bigscience |bigcode )?open ?rail(-?[+]*-?m)?( licen[cs]e)?\b
5 use-based the use based restrictions as referenced in paragraph 5
= proprietary
5 all rights reserved \bcopyright .{1,80} all rights reserved\b
3 proprietary \b(proprietary and confidential|proprietary licen[cs]e)\b
3 end user \bend user licen[cs]e agreement\b
"""
