"""License scans: ordered signature rules with a keyword prefilter, priorities and interval containment.

The signatures are written by hand: names of licenses, sentences of their texts, addresses, and notices that name none. A name
gives up to four rules, from strong to weak: an SPDX tag, a grant ("licensed under ..."), an address, and a mention. A text
is searched for the rules' keywords by one automaton first; only rules whose keyword occurs are tried. Names may be wrapped:
white space is folded for the search, and SPDX expressions are read id by id. Of overlapping detections, one that lies inside
another of the same or higher priority is dropped (of equal spans the earlier rule stays). The base labels (mit, apache, gpl) come from consecutive words and always stay.

Defined cases: null text counts as empty (no words, no labels, score 0, null first_word and last_word); a null doc_id is
carried; rows repeated whole are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_state

# fixed values: (label, name as a pattern, keyword, address as a pattern or "")
LICENSES = [
    ("mit", r"(?:the )?mit(?: open source)? licen[sc]e|expat licen[sc]e", "mit licen|mit open source|expat licen", r"opensource\.org/licenses?/mit"),
    ("mit-0", r"mit no attribution(?: licen[sc]e)?|mit-0", "mit no attribution|mit-0", ""),
    ("apache-2.0", r"apache(?: software)?(?: foundation)? licen[sc]e,? ?\(?(?:version|v\.?)? ?2(?:\.0)?\)?", "apache", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", r"apache(?: software)? licen[sc]e,? ?(?:version|v\.?)? ?1\.1", "apache", r"apache\.org/licenses/license-1\.1"),
    ("apache-1.0", r"apache(?: software)? licen[sc]e,? ?(?:version|v\.?)? ?1\.0", "apache", r"apache\.org/licenses/license-1\.0"),
    ("gpl-1.0", r"gnu general public licen[sc]e,? ?(?:version|v\.?)? ?1(?:\.0)?(?! or)", "general public", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?\(?(?:version|v\.?)? ?2(?:\.0)?(?:-only)?\)?", "gpl|general public", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?\(?(?:version|v\.?)? ?3(?:\.0)?(?:-only)?\)?", "gpl|general public", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2.0-or-later", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version|v\.?)? ?2(?:\.0)?,? (?:or|and) (?:\(at your option\) )?(?:any )?later", "or later|and later|any later|option) later", ""),
    ("gpl-3.0-or-later", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version|v\.?)? ?3(?:\.0)?,? (?:or|and) (?:\(at your option\) )?(?:any )?later", "or later|and later|any later|option) later", ""),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public licen[sc]e|lgpl),? ?(?:version|v\.?)? ?2(?:\.0)?(?!\.1)", "lgpl|library general", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version|v\.?)? ?2\.1", "lgpl|lesser general", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version|v\.?)? ?3(?:\.0)?", "lgpl|lesser general", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-1.0", r"affero general public licen[sc]e,? ?(?:version|v\.?)? ?1(?:\.0)?", "affero", r"affero\.org/oagpl"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[sc]e|agpl),? ?(?:version|v\.?)? ?3(?:\.0)?", "affero|agpl", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.1", r"gnu free documentation licen[sc]e,? ?(?:version|v\.?)? ?1\.1", "free documentation", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.1"),
    ("gfdl-1.2", r"gnu free documentation licen[sc]e,? ?(?:version|v\.?)? ?1\.2", "free documentation", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2"),
    ("gfdl-1.3", r"gnu free documentation licen[sc]e,? ?(?:version|v\.?)? ?1\.3", "free documentation", r"gnu\.org/licenses/fdl-1\.3"),
    ("bsd-2-clause", r"(?:the )?(?:simplified|freebsd|2-clause|two-clause) bsd licen[sc]e|bsd[ -]2[ -]clause", "bsd", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", r"(?:the )?(?:new|modified|revised|3-clause|three-clause) bsd licen[sc]e|bsd[ -]3[ -]clause", "bsd", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", r"(?:the )?(?:original|old|4-clause|four-clause) bsd licen[sc]e|bsd[ -]4[ -]clause", "bsd", r"spdx\.org/licenses/bsd-4-clause"),
    ("0bsd", r"(?:zero[ -]clause|0-clause|free public) bsd(?: licen[sc]e)?", "bsd", r"opensource\.org/licenses?/0bsd"),
    ("isc", r"isc licen[sc]e", "isc licen", r"opensource\.org/licenses?/isc"),
    ("mpl-1.0", r"mozilla public licen[sc]e,? ?(?:version|v\.?)? ?1\.0", "mozilla", r"mozilla\.org/mpl/1\.0"),
    ("mpl-1.1", r"mozilla public licen[sc]e,? ?(?:version|v\.?)? ?1\.1", "mozilla", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", r"mozilla public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?|mpl[ -]2\.0", "mozilla|mpl-2|mpl 2", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", r"eclipse public licen[sc]e,? ?(?:version|v\.?|-)? ?1\.0", "eclipse", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", r"eclipse public licen[sc]e,? ?(?:version|v\.?|-)? ?2\.0", "eclipse", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("edl-1.0", r"eclipse distribution licen[sc]e,? ?(?:version|v\.?|-)? ?1\.0", "eclipse", r"eclipse\.org/org/documents/edl-v10"),
    ("cddl-1.0", r"common development and distribution licen[sc]e,? ?\(?(?:cddl)?\)?,? ?(?:version|v\.?)? ?1\.0", "common development", r"opensource\.org/licenses?/cddl-1\.0"),
    ("cddl-1.1", r"common development and distribution licen[sc]e,? ?\(?(?:cddl)?\)?,? ?(?:version|v\.?)? ?1\.1", "common development", ""),
    ("cpl-1.0", r"common public licen[sc]e,? ?(?:version|v\.?)? ?1\.0", "common public", r"opensource\.org/licenses?/cpl1\.0"),
    ("ipl-1.0", r"ibm public licen[sc]e,? ?(?:version|v\.?)? ?1\.0", "ibm public", ""),
    ("ms-pl", r"microsoft public licen[sc]e|ms-pl", "microsoft|ms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e|ms-rl", "microsoft|ms-rl", r"opensource\.org/licenses?/ms-rl"),
    ("artistic-1.0", r"(?:perl )?artistic licen[sc]e,? ?(?:version|v\.?)? ?1\.0", "artistic licen", r"opensource\.org/licenses?/artistic-1\.0"),
    ("artistic-2.0", r"(?:perl )?artistic licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?", "artistic licen", r"opensource\.org/licenses?/artistic-2\.0"),
    ("bsl-1.0", r"boost software licen[sc]e(?:,? ?-? ?(?:version|v\.?)? ?1\.0)?", "boost software", r"boost\.org/license_1_0"),
    ("busl-1.1", r"business source licen[sc]e(?:,? ?(?:version|v\.?)? ?1\.1)?", "business source", r"mariadb\.com/bsl11"),
    ("sspl-1.0", r"server side public licen[sc]e(?:,? ?(?:version|v\.?)? ?1)?", "server side public", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", r"elastic licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?", "elastic licen", r"elastic\.co/licensing/elastic-license"),
    ("unlicense", r"the unlicense", "unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the f[*u][*c]k you want to public licen[sc]e|wtfpl", "wtfpl|do what the", r"wtfpl\.net"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib", r"opensource\.org/licenses?/zlib"),
    ("libpng", r"libpng licen[sc]e|png reference library licen[sc]e", "libpng|png reference", r"libpng\.org/pub/png/src/libpng-license"),
    ("openssl", r"openssl licen[sc]e", "openssl", r"openssl\.org/source/license"),
    ("php-3.01", r"php licen[sc]e,? ?(?:version|v\.?)? ?3\.01?", "php licen", r"php\.net/license/3_01"),
    ("psf-2.0", r"python software foundation licen[sc]e(?:,? ?(?:version|v\.?)? ?2(?:\.0)?)?|psf licen[sc]e", "python software|psf licen", r"docs\.python\.org/3/license"),
    ("ruby", r"ruby licen[sc]e", "ruby licen", r"ruby-lang\.org/en/about/license"),
    ("postgresql", r"postgresql licen[sc]e", "postgresql", r"opensource\.org/licenses?/postgresql"),
    ("ncsa", r"university of illinois/?ncsa open source licen[sc]e|ncsa open source licen[sc]e", "ncsa", r"otm\.illinois\.edu/(?:uiuc_opensource|disclose-protect)"),
    ("eupl-1.1", r"european union public licen[sc]e,? ?(?:version|v\.?)? ?1\.1|eupl,? ?(?:v\.?)? ?1\.1", "european union public|eupl", r"joinup\.ec\.europa\.eu/.{0,40}eupl-1\.1"),
    ("eupl-1.2", r"european union public licen[sc]e,? ?(?:version|v\.?)? ?1\.2|eupl,? ?(?:v\.?)? ?1\.2", "european union public|eupl", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("osl-3.0", r"open software licen[sc]e,? ?(?:version|v\.?)? ?3\.0", "open software licen", r"opensource\.org/licenses?/osl-3\.0"),
    ("afl-3.0", r"academic free licen[sc]e,? ?(?:version|v\.?)? ?3\.0", "academic free", r"opensource\.org/licenses?/afl-3\.0"),
    ("ecl-2.0", r"educational community licen[sc]e,? ?(?:version|v\.?)? ?2\.0", "educational community", r"opensource\.org/licenses?/ecl-2\.0"),
    ("upl-1.0", r"universal permissive licen[sc]e(?:,? ?(?:version|v\.?)? ?1\.0)?", "universal permissive", r"oss\.oracle\.com/licenses/upl"),
    ("odbl-1.0", r"open (?:data commons )?(?:open )?database licen[sc]e(?: ?\(odbl\))?", "database licen", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e|odc-by", "open data commons|odc-by", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", r"public domain dedication and licen[sc]e|pddl", "public domain|pddl", r"opendatacommons\.org/licenses/pddl"),
    ("ofl-1.1", r"sil open font licen[sc]e,? ?(?:version|v\.?)? ?1\.1", "open font", r"scripts\.sil\.org/ofl"),
    ("llama-2", r"llama 2 community licen[sc]e", "llama 2", ""),
    ("openrail-m", r"(?:creativeml |bigscience )?open ?rail(?:\+\+)?-m", "openrail|open rail|open-rail", ""),
    ("cc0-1.0", r"(?:creative commons|cc)[ -]?(?:zero|0)(?:,? ?(?:universal)? ?(?:version|v\.?)? ?1\.0)?(?: universal)?", "cc0|cc zero|cc-zero|cczero|cc 0|cc-0|creative commons", r"creativecommons\.org/publicdomain/zero/1\.0"),
]

CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
_CC_WORDS = {"by": "attribution", "sa": "share ?-?alike", "nd": "no ?-?deriv(?:ative)?s?(?: works)?", "nc": "non ?-?commercial"}
GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistribute it) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
KIND_SCORE = {"spdx": 0.99, "grant": 0.95, "address": 0.9, "text": 0.85, "mention": 0.75, "notice": 0.6}
PRIORITY = {"spdx": 4, "grant": 3, "address": 2, "text": 2, "mention": 1, "notice": 0}
# fixed values: (label, sentence of the license's text or notice as a pattern, keywords)
SENTENCES = [
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "any person obtaining a copy"),
    ("mit", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software", "substantial portions of the software"),
    ("x11", r"except as contained in this notice, the names? of .{1,80}? shall not be used in advertising", "except as contained in this notice"),
    ("isc", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source code"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form"),
    ("bsd-3-clause", r"neither the names? of .{1,100}? nor the names of (?:its|their) contributors may be used to endorse or promote products", "nor the names of"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials"),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[sc]e", "except in compliance"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e", "required by applicable law"),
    ("apache-2.0", r"subject to the terms and conditions of this licen[sc]e, each contributor hereby grants to you a perpetual", "each contributor hereby grants"),
    ("apache-2.0", r"licensed to the apache software foundation \(asf\) under one or more contributor licen[sc]e agreements", "contributor licen"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "software developed by the apache"),
    ("gpl", r"this program is distributed in the hope that it will be useful, but without any warranty", "in the hope that it will be useful"),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e", "should have received a copy"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "should have received a copy"),
    ("agpl-3.0", r"you should have received a copy of the gnu affero general public licen[sc]e", "should have received a copy"),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it", "take away your freedom"),
    ("gpl-2.0", r"you may not copy, modify, sublicense, or distribute the program except as expressly provided under this licen[sc]e", "sublicense, or distribute the program"),
    ("gpl-3.0", r"is a free, copyleft licen[sc]e for software and other kinds of works", "free, copyleft"),
    ("gpl-3.0", r"you may convey verbatim copies of the program.s source code as you receive it", "convey verbatim copies"),
    ("lgpl-2.1", r"this licen[sc]e, the lesser general public licen[sc]e, applies to some specially designated software packages", "specially designated software"),
    ("lgpl-3.0", r"this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3", "incorporates the terms and conditions"),
    ("agpl-3.0", r"your modified version must prominently offer all users interacting with it remotely through a computer network", "interacting with it remotely"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e", "modify this document under the terms"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e, v\. ?2\.0", "source code form is subject"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[sc]e version 1\.1", "contents of this file are subject"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse (?:public|distribution) licen[sc]e", "accompanying materials are made available"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "contents of this file are subject"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "free and unencumbered"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "anyone is free to copy"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document", "verbatim or modified copies"),
    ("zlib", r"the origin of this software must not be misrepresented", "must not be misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such", "altered source versions"),
    ("bsl-1.0", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e", "person or organization obtaining a copy"),
    ("cc0-1.0", r"to the extent possible under law, .{1,120}? ha(?:s|ve) waived all copyright and related or neighbou?ring rights", "to the extent possible under law"),
    ("cc0-1.0", r"has dedicated the work to the public domain by waiving all of (?:his or her|their) rights", "dedicated the work to the public domain"),
    ("ofl-1.1", r"this font software is licensed under the sil open font licen[sc]e", "font software is licensed"),
    ("ofl-1.1", r"the fonts and derivatives, however, cannot be released under any other type of licen[sc]e", "fonts and derivatives"),
    ("psf-2.0", r"psf is making python available to licensee on an .?as is.? basis", "making python available"),
    ("openssl", r"this product includes software developed by the openssl project", "developed by the openssl"),
    ("openssl", r"this product includes cryptographic software written by eric young", "written by eric young"),
    ("php-3.01", r"this product includes php software", "includes php software"),
    ("postgresql", r"for any purpose, without fee, and without a written agreement is hereby granted", "without a written agreement"),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted", "software and its documentation for any purpose"),
    ("beerware", r"you can buy me a beer in return|beer-?ware licen[sc]e", "buy me a beer|beerware|beer-ware"),
    ("json", r"the software shall be used for good, not evil", "used for good, not evil"),
    ("blessing", r"may you do good and not evil", "do good and not evil"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("freetype", r"portions of this software are copyright .{1,40}? the freetype project|the freetype project licen[sc]e", "freetype project"),
    ("vim", r"vim is charityware", "charityware"),
    ("w3c", r"w3c(?:\(r\)|®)? software (?:notice and )?licen[sc]e", "w3c software|w3c(r) software|w3c® software"),
    ("tcl", r"the authors hereby grant permission to use, copy, modify, distribute, and licen[sc]e this software and its documentation", "authors hereby grant permission"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service", "functionality of the program"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use", "non-production use"),
    ("commons-clause", r"commons clause(?: licen[sc]e)? condition", "commons clause"),
    ("polyform", r"polyform (?:noncommercial|shield|strict|small business|perimeter|free trial|internal use)", "polyform"),
    ("confluent-community", r"confluent community licen[sc]e", "confluent community"),
    ("hippocratic", r"hippocratic licen[sc]e", "hippocratic licen"),
    ("anti-996", r"anti[ -]?996 licen[sc]e", "anti 996|anti-996|anti996"),
    ("mulan-psl-2.0", r"mulan (?:psl|permissive software licen[sc]e),? ?(?:v|version )?2", "mulan psl|mulan permissive"),
    ("cecill", r"cecill(?:-[bc])? (?:free software )?licen[sc]e|licence cecill", "cecill"),
    ("ogl-uk", r"open government licen[sc]e", "open government"),
    ("etalab", r"licence ouverte", "licence ouverte"),
    ("dl-de", r"datenlizenz deutschland", "datenlizenz"),
    ("cdla-permissive", r"community data licen[sc]e agreement.{0,4}permissive|cdla-permissive", "community data|cdla-permissive"),
    ("cdla-sharing", r"community data licen[sc]e agreement.{0,4}sharing|cdla-sharing", "community data|cdla-sharing"),
    ("llama-3", r"llama 3(?:\.[123])? community licen[sc]e", "llama 3"),
    ("gemma", r"gemma terms of use", "gemma terms"),
    ("bigscience-rail", r"bigscience (?:bloom )?rail licen[sc]e", "bigscience"),
    ("apsl", r"apple public source licen[sc]e", "apple public source"),
    ("nasa", r"nasa open source agreement", "nasa open source"),
    ("qpl", r"q public licen[sc]e", "q public licen"),
    ("sleepycat", r"sleepycat licen[sc]e", "sleepycat"),
    ("rpl", r"reciprocal public licen[sc]e", "reciprocal public"),
    ("cpal-1.0", r"common public attribution licen[sc]e", "common public attribution"),
    ("lppl", r"latex project public licen[sc]e", "latex project public"),
    ("unicode", r"unicode(?:, inc\.)? licen[sc]e(?: agreement)?", "unicode licen|unicode, inc. licen"),
    ("icu", r"icu licen[sc]e", "icu licen"),
    ("glwtpl", r"good luck with that (?:shit )?public licen[sc]e", "good luck with that"),
    ("watcom", r"sybase open watcom public licen[sc]e", "open watcom"),
    ("cua-opl", r"cua office public licen[sc]e", "cua office"),
    ("nokia", r"nokia open source licen[sc]e", "nokia open source"),
    ("sun-sissl", r"sun industry standards source licen[sc]e", "sun industry standards"),
    ("spl", r"sun public licen[sc]e", "sun public licen"),
    ("interbase", r"interbase public licen[sc]e", "interbase public"),
    ("netscape", r"netscape public licen[sc]e", "netscape public"),
    ("ofl-1.0", r"sil open font licen[sc]e,? ?(?:version|v\.?)? ?1\.0", "open font"),
    ("odbl-1.0", r"any rights in individual contents of the database are licensed under the database contents licen[sc]e", "database contents licen"),
    ("no-ai-training", r"(?:may not|must not|shall not) be used (?:to train|for training) (?:any )?(?:artificial intelligence|machine learning|ai|language) models?", "to train|for training"),
    ("no-redistribution", r"redistribution(?:, in whole or in part,)? is (?:strictly )?(?:prohibited|forbidden|not permitted)", "redistribution"),
    ("no-derivatives", r"no derivative works (?:are )?(?:allowed|permitted)", "no derivative works"),
    ("personal-use", r"for personal(?:,? non-?commercial)? use only", "for personal"),
    ("eula", r"end[ -]user licen[sc]e agreement", "end user licen|end-user licen"),
    ("evaluation", r"(?:licensed )?for evaluation purposes only", "evaluation purposes"),
]
# fixed values: notices that name no license
NOTICES = [
    ("all-rights-reserved", r"all rights reserved", "all rights reserved"),
    ("proprietary", r"proprietary and confidential|unauthorized (?:copying|use|distribution) (?:of this file )?is (?:strictly )?prohibited", "proprietary|unauthorized"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|in)?to the public domain|in the public domain", "public domain"),
    ("permissive-text", r"permission is hereby granted,? free of charge", "permission is hereby"),
    ("bsd-text", r"redistribution and use in source and binary forms", "redistribution and use"),
    ("copyleft-text", r"this program is free software[:;,]? you can redistribute it", "free software"),
    ("no-warranty", r"provided [\"'“]?as[ -]is[\"'”]?,? without (?:any )?warrant(?:y|ies)", "as is|as-is"),
    ("non-commercial", r"(?:for )?non-?commercial use only", "commercial use"),
    ("copyright", r"(?:copyright )?(?:\(c\)|©) ?(?:copyright )?\d{4}", "(c)|©"),
]


def rules() -> list[tuple[str, str, str, re.Pattern]]:
    """(label, kind, keywords, pattern) in order of priority; over 400 of them."""
    table = list(LICENSES)
    for kind in CC_KINDS:
        for version in CC_VERSIONS:
            words = r"[ -]".join(_CC_WORDS[p] for p in kind.split("-"))
            name = rf"cc[ -]{kind.replace('-', '[ -]')}[ -]{re.escape(version)}|creative commons {words}(?: {re.escape(version)})?(?: international| unported| generic)? licen[sc]e|creative commons {words} {re.escape(version)}"
            table.append((f"cc-{kind}-{version}", name, "cc by|cc-by|creative commons", rf"creativecommons\.org/licenses/{kind}/{re.escape(version)}"))
    out = []
    for label, name, key, address in table:
        edge = rf"(?<![0-9a-z])(?:{name})(?![0-9a-z])"
        out.append((label, "spdx", "spdx-license", rf"spdx-license-identifier:\s{{0,4}}{re.escape(label)}(?![0-9a-z.-])"))
        out.append((label, "grant", key, GRANT.replace(" ", r"\s{1,4}") + rf"(?:{name})(?![0-9a-z])"))
        if address:
            out.append((label, "address", address.split("/")[0].replace("\\", ""), rf"(?:https?://)?(?:www\.)?{address}"))
        out.append((label, "mention", key, edge))
    out += [(label, "text", key, rf"(?<![0-9a-z])(?:{sentence})(?![0-9a-z])") for label, sentence, key in SENTENCES]
    out += [(label, "notice", key, rf"(?<![0-9a-z])(?:{name})") for label, name, key in NOTICES]
    out.sort(key=lambda r: -PRIORITY[r[1]])
    return [(label, kind, key, re.compile(pattern)) for label, kind, key, pattern in out]


_SPDX = re.compile(r"spdx-license-identifier:\s{0,4}(\(*[0-9a-z.+-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[0-9a-z.+-]+\)*)*)")
_SPDX_PART = re.compile(r"[0-9a-z.+-]+")
_GNU = ("gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-1.0", "agpl-3.0", "gfdl-1.1", "gfdl-1.2", "gfdl-1.3")  # fixed values


def spdx_ids() -> dict[str, str]:
    """Labels of the ids that an SPDX expression may hold; -only is the version itself, -or-later and + have own labels."""
    out = {label: label for label, kind, _, _ in rules() if kind == "spdx"}
    for x in _GNU:
        out |= {f"{x}-only": x, f"{x}-or-later": f"{x}-or-later", f"{x}+": f"{x}-or-later"}
    return out


def folded(low: str) -> tuple[str, list[int], list[int]]:
    """low with every run of white space as one space, and where (in the result) how many characters went before."""
    text = _OTHER_SPACE.sub(" ", low)
    if "  " not in text:
        return text, [], []
    at, gone, total = [], [], 0
    for m in _SPACES.finditer(text):
        total += m.end() - m.start() - 1
        at.append(m.end() - total)
        gone.append(total)
    return _SPACES.sub(" ", text), at, gone


_OTHER_SPACE, _SPACES = re.compile(r"[^\S ]"), re.compile(r" {2,}")
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))  # fixed values
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.by_key: dict[str, list[int]] = {}
        for i, (_, _, keys, _) in enumerate(self.rules):
            for key in keys.split("|"):
                self.by_key.setdefault(key, []).append(i)
        self.ids = spdx_ids()
        self.auto = ahocorasick.Automaton()
        for key in self.by_key:
            self.auto.add_word(key, key)
        self.auto.make_automaton()
        self.word = re.compile(_WORD + "+")
        self.phrases = [(label, phrase, re.compile(rf"(?<!{_WORD}){(_GAP + '+').join(phrase.split())}(?!{_WORD})")) for label, phrase in PHRASES]

    def detections(self, low: str) -> list[tuple[int, int, str, str]]:
        """(start, end, label, kind) that no other detection contains, by start."""
        text, at, gone = folded(low)
        keys = {key for _, key in self.auto.iter(text)}
        found = []
        if "spdx-license" in keys:
            for m in _SPDX.finditer(low):
                follows_with = False
                for part in _SPDX_PART.finditer(low, m.start(1), m.end(1)):
                    word = part.group().rstrip(".-")
                    if word in ("and", "or", "with"):
                        follows_with = word == "with"
                    elif word in self.ids and not follows_with:  # what follows "with" is an exception
                        start = m.start() if part.start() == m.start(1) else part.start()
                        found.append((start, part.start() + len(word), -1, self.ids[word], "spdx"))
        for i in sorted({i for key in keys for i in self.by_key[key]}):
            label, kind, _, pattern = self.rules[i]
            for m in pattern.finditer(text):
                start, end = m.start(), m.end()
                if at:  # back to places in low; an end goes with the character before it
                    a, b = bisect_right(at, start), bisect_right(at, end - 1)
                    start, end = start + (gone[a - 1] if a else 0), end + (gone[b - 1] if b else 0)
                found.append((start, end, i, label, kind))
        # by start, longest first: of those begun earlier, only the ones of greatest end per priority can contain
        found.sort(key=lambda x: (x[0], -x[1], x[2]))
        reach = [-1] * (max(PRIORITY.values()) + 1)  # greatest end so far of detections of this priority or a higher one
        out = []
        for start, end, _, label, kind in found:
            p = PRIORITY[kind]
            if reach[p] >= end:
                continue
            out.append((start, end, label, kind))
            for q in range(p + 1):
                reach[q] = max(reach[q], end)
        return out

    def __call__(self, text: str) -> tuple:
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        n_words = len(self.word.findall(low))
        starts, base = [], set()
        for label, phrase, pattern in self.phrases:
            if phrase.rsplit(" ", 1)[-1] in low and phrase.split(" ", 1)[0] in low:
                at = [m.start() for m in pattern.finditer(low)]
                starts += at
                if at:
                    base.add(label)
        index = lambda p: len(self.word.findall(low, 0, p))
        found = self.detections(low)
        labels = base | {label for _, _, label, _ in found}
        score = max([KIND_SCORE[kind] for *_, kind in found] + [0.75] * bool(base), default=0.0)
        return (
            n_words, len(starts), index(min(starts)) if starts else None, index(max(starts)) if starts else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(f"{label}:{kind}:{s}:{e}" for s, e, label, kind in found),
        )


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the columns of COLUMNS; detections are label:kind:start:end in code points."""
    small_batches(docs.sparkSession)

    def run(batches):
        scan = worker_state("license_scanner", Scanner)
        for pdf in batches:
            rows = [scan(t or "") for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=COLUMNS)
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.astype({c: "Int64" for c in COLUMNS[:4]})

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInPandas(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string")
