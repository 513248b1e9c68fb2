"""Signature rules of the license scan, written by hand.

A line is (label, keyword, priority, weight, pattern).  In a pattern a space stands for any run of ASCII marks and spaces
between words, and the whole stands at word edges; `` ~ `` stands for up to 24 words in between; case does not matter.  The keyword is a word that no match can lack;
the rule runs only on texts that hold it as a word.  Priorities: 1 identifier, 2 full notice, 3 name and version, 4 name
alone, 5 hint.  Within a priority, earlier rules win ties.
"""

from __future__ import annotations

#: What may open a grant: it belongs to the name that follows, so the name's span holds the bare hint's.
LEAD = "(?:(?:(?:re)?licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?)?"

NOTICES = (
    # permissive grants
    ("mit", "granted", 2, 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "granted", 2, 0.9, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "merge", 2, 0.8, "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", 2, 0.75, "(?:the )?above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions"),
    ("mit", "noninfringement", 2, 0.6, "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-0", "granted", 2, 0.9, "permission is hereby granted to use copy modify (?:and )?(?:or )?distribute this software without restriction"),
    ("mit-no-advertising", "advertising", 2, 0.7, "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("isc", "permission", 2, 0.9, "permission to use copy modify and(?: or)? distribute this software (?:and its documentation )?for any purpose with or without fee is hereby granted"),
    ("isc", "permission", 2, 0.85, "permission to use copy modify and or distribute this software for any purpose"),
    ("hpnd", "supporting", 2, 0.8, "(?:both )?that copyright notice and this permission notice appear in supporting documentation"),
    ("hpnd", "suitability", 2, 0.7, "makes no representations about the suitability of this software for any purpose"),
    ("bsd", "redistribution", 2, 0.85, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution", 2, 0.8, "redistribution and use in source and binary forms"),
    ("bsd", "redistributions", 2, 0.8, "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 2, 0.8, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "endorse", 2, 0.9, "neither the names? of ~ nor the names of (?:its|their|any) contributors may be used to endorse"),
    ("bsd-3", "contributors", 2, 0.9, "neither the name of the copyright holder nor the names of its contributors"),
    ("bsd-3", "endorse", 2, 0.8, "may (?:not )?be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-4", "acknowledgement", 2, 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-patent", "patent", 2, 0.8, "each copyright holder and contributor hereby grants ~ patent licen[sc]e"),
    ("apache-2", "applicable", 2, 0.85, "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache", "applicable", 2, 0.8, "unless required by applicable law or agreed to in writing software"),
    ("apache-2", "apache", 2, 0.95, "you may not use this file except in compliance with the licen[sc]e ~ apache org licenses license 2 0"),
    ("apache", "compliance", 2, 0.6, "you may not use this file except in compliance with the licen[sc]e"),
    ("zlib", "express", 2, 0.7, "this software is provided as is without any express or implied warranty"),
    ("zlib", "misrepresented", 2, 0.9, "the origin of this software must not be misrepresented"),
    ("zlib", "altered", 2, 0.85, "altered source versions must be plainly marked as such"),
    ("boost", "machine", 2, 0.85, "solely in the form of machine executable object code generated by a source language processor"),
    ("libpng", "libpng", 2, 0.85, "this copy of the libpng notices is provided"),
    ("libpng", "png", 2, 0.85, "png reference library is supplied as is"),
    ("ncsa", "illinois", 2, 0.85, "neither the names of ~ university of illinois"),
    ("openssl", "openssl", 2, 0.9, "this product includes software developed by the openssl project"),
    ("openssl", "cryptographic", 2, 0.85, "this product includes cryptographic software written by eric young"),
    ("php", "php", 2, 0.9, "this product includes php(?: software)? freely available from"),
    ("beerware", "beer", 2, 0.9, "if we meet (?:some ?day|again) and you think this stuff is worth it you can buy me a beer"),
    ("wtfpl", "fuck", 2, 0.95, "you just do what the fuck you want to"),
    ("unlicense", "unencumbered", 2, 0.95, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", 2, 0.9, "for more information please refer to (?:the )?(?:https? )?unlicense(?: org)?"),
    ("cc0", "waived", 2, 0.9, "(?:has|have) waived all copyright and related or neighbou?ring rights"),
    # copyleft grants
    ("gpl", "redistribute", 2, 0.9, "this program is free software:? you can redistribute it and(?: or)? modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "redistribute", 2, 0.85, "this (?:program|software|file|script|code|package) is free software you (?:can|may) redistribute it and or modify it"),
    ("gpl", "usefulness", 2, 0.6, "without any warranty without even the implied warranty of usefulness"),
    ("gpl", "useful", 2, 0.7, "(?:this program is|it is) distributed in the hope that it will be useful"),
    ("gpl", "gnu", 2, 0.75, "you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl-2", "foundation", 2, 0.9, "gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or (?:at your option )?any later version"),
    ("gpl-3", "foundation", 2, 0.9, "gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or (?:at your option )?any later version"),
    ("gpl-2-only", "foundation", 2, 0.9, "gnu general public licen[sc]e version 2 (?:only )?as published by the free software foundation"),
    ("gpl", "foundation", 2, 0.6, "free software foundation inc 5[19] (?:temple place|franklin st(?:reet)?)"),
    ("lgpl-2.1", "library", 2, 0.9, "this library is free software you can redistribute it and(?: or)? modify it"),
    ("lgpl", "lesser", 2, 0.8, "you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl", "lesser", 2, 0.85, "gnu lesser general public licen[sc]e as published by the free software foundation"),
    ("lgpl-2", "library", 2, 0.85, "gnu library general public licen[sc]e as published by the free software foundation"),
    ("agpl-3", "affero", 2, 0.85, "gnu affero general public licen[sc]e as published by the free software foundation"),
    ("agpl-3", "affero", 2, 0.85, "you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl-classpath", "exception", 2, 0.9, "as a special exception the copyright holders of this library give you permission to link"),
    ("gpl-classpath", "classpath", 3, 0.85, "classpath exception"),
    ("gpl-gcc", "runtime", 3, 0.85, "gcc runtime library exception"),
    ("gpl-font", "font", 3, 0.8, "(?:gpl )?font (?:embedding )?exception"),
    ("gpl-openssl", "openssl", 2, 0.85, "permission to link ~ with the openssl (?:library|project)"),
    ("mpl-2", "mozilla", 2, 0.95, "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-2", "incompatible", 2, 0.85, "this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "mozilla", 2, 0.9, "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("cddl-1", "cddl", 2, 0.9, "the contents of this file are subject to the terms of the ~ cddl"),
    ("epl-1", "eclipse", 2, 0.95, "accompanying materials are made available under the terms of the eclipse public licen[sc]e v(?:ersion )?1 0"),
    ("epl-2", "eclipse", 2, 0.95, "accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v(?:ersion )?)?2 0"),
    ("edl", "eclipse", 2, 0.9, "made available under the terms of the eclipse distribution licen[sc]e"),
    ("gfdl", "documentation", 2, 0.9, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gfdl", "invariant", 2, 0.75, "with no invariant sections no front cover texts and no back cover texts"),
    ("eupl", "eupl", 2, 0.85, "you may not use this work except in compliance with the licen[sc]e ~ eupl"),
    ("ofl", "font", 2, 0.9, "this font software is licensed under the sil open font licen[sc]e"),
    ("ofl", "reserved", 2, 0.8, "with reserved font names?"),
    ("same-terms", "perl", 3, 0.8, "under the same terms as perl(?: 5)?(?: itself)?"),
    ("same-terms", "itself", 3, 0.7, "redistribute it and or modify it under the same terms as ~ itself"),
    # data, weights, works
    ("odbl", "database", 2, 0.9, "this ~ is made available under the open database licen[sc]e"),
    ("odbl", "openstreetmap", 3, 0.8, "(?:©|copyright|data) openstreetmap contributors"),
    ("odc-by", "attribution", 2, 0.9, "made available under the open data commons attribution licen[sc]e"),
    ("ogl", "open", 2, 0.9, "contains public sector information licensed under the open government licen[sc]e"),
    ("openrail", "rail", 3, 0.85, "(?:creativeml |bigscience |bigcode )?open rail(?: [msd])?(?: licen[sc]e)?"),
    ("openrail", "openrail", 3, 0.85, "(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[sc]e)?"),
    ("research-only", "research", 3, 0.7, "for (?:non ?commercial )?research (?:purposes|use) only"),
    ("academic-only", "academic", 3, 0.7, "(?:free )?for academic (?:and research )?use only"),
    ("evaluation-only", "evaluation", 3, 0.65, "for evaluation purposes only"),
    ("no-training", "train", 3, 0.85, "may not be used to train"),
    ("no-training", "training", 3, 0.85, "(?:(?:not (?:permitted|allowed|licensed|to be used)|may not be used|no use) for )(?:(?:ai|machine learning|model) )?training"),
    ("no-mining", "mining", 3, 0.8, "text and data mining (?:is |are )?(?:not permitted|prohibited|reserved|rights reserved)"),
    # public domain
    ("public-domain", "domain", 3, 0.75, "(?:this (?:work|file|text|book|image) is )?(?:hereby )?(?:released|placed|put|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", 3, 0.75, "(?:this work|this file|this book|it) is (?:now )?in the public domain"),
    ("public-domain", "domain", 3, 0.65, "public domain (?:work|text|book|dedication|mark)"),
    ("public-domain", "copyright", 3, 0.7, "no (?:known )?copyright (?:restrictions|is claimed)"),
    ("us-government", "government", 3, 0.75, "works? of the (?:u s|united states) (?:federal )?government"),
    ("crown", "crown", 3, 0.75, "crown copyright(?: and database rights?| reserved)?"),
    ("gutenberg", "gutenberg", 2, 0.9, "this ebook is for the use of anyone anywhere ~ project gutenberg licen[sc]e"),
    ("gutenberg", "gutenberg", 3, 0.75, "project gutenberg(?: tm)? licen[sc]e"),
    # closed
    ("proprietary", "proprietary", 2, 0.8, "(?:contains )?(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
    ("proprietary", "confidential", 3, 0.65, "strictly confidential|company confidential|confidential material"),
    ("proprietary", "unauthorized", 3, 0.75, "unauthorized (?:copying|reproduction|use|distribution|duplication)(?: or (?:copying|reproduction|use|distribution|duplication))? (?:of this (?:file|document|material|work)|(?:via any medium )?is (?:strictly )?prohibited)"),
    ("proprietary", "unauthorised", 3, 0.75, "unauthorised (?:copying|reproduction|use|distribution)(?: of this (?:file|document|material|work))?"),
    ("proprietary", "reproduced", 2, 0.75, "no part of this (?:publication|book|document|work|website|site) may be (?:(?:copied|stored|transmitted) (?:or )?)*reproduced"),
    ("proprietary", "reproduced", 3, 0.65, "may not be (?:copied (?:or|and) )?reproduced (?:or redistributed )?without (?:prior )?(?:written )?permission"),
    ("proprietary", "redistributed", 3, 0.7, "this material may not be published broadcast rewritten or redistributed"),
    ("proprietary", "nondisclosure", 3, 0.7, "subject to (?:a )?nondisclosure agreement"),
    ("proprietary", "disclosed", 3, 0.65, "(?:may|shall|must) not be disclosed to (?:any )?third part(?:y|ies)"),
    ("proprietary", "patents", 5, 0.3, "protected by (?:u s )?(?:and international )?patents"),
    ("proprietary", "trade", 3, 0.6, "contains trade secrets"),
    ("eula", "eula", 4, 0.6, "(?:end user licen[sc]e agreement )?eula"),
    ("eula", "end", 4, 0.6, "end user licen[sc]e agreement"),
    ("eula", "clicking", 3, 0.7, "by (?:clicking|clicking on) (?:i )?(?:accept|agree) ~ you agree to be bound"),
    ("no-redistribution", "redistribution", 3, 0.6, "not for (?:re)?sale or redistribution|not for redistribution|redistribution (?:is )?(?:not permitted|prohibited)"),
    ("no-redistribution", "resale", 3, 0.6, "not for resale(?: or distribution)?"),
    ("no-derivatives", "derivative", 3, 0.65, "(?:no|without) derivative works|derivative works (?:are )?(?:not permitted|prohibited)"),
    ("non-commercial", "commercial", 3, 0.7, "for non commercial (?:use|purposes) only|non commercial use only"),
    ("non-commercial", "noncommercial", 3, 0.7, "(?:for )?noncommercial (?:use|purposes) only"),
    ("non-commercial", "commercial", 3, 0.65, "(?:not for|no) commercial (?:use|purposes?)|commercial use (?:is )?(?:not permitted|prohibited)"),
    ("non-commercial", "personal", 3, 0.6, "(?:free )?for personal (?:and non commercial )?use(?: only)?"),
    ("non-commercial", "polyform", 3, 0.85, "polyform non ?commercial(?: licen[sc]e)?(?: 1 0 0)?"),
    ("source-available", "polyform", 3, 0.8, "polyform (?:strict|small business|shield|perimeter|internal use)(?: licen[sc]e)?"),
    ("source-available", "commons", 3, 0.8, "commons clause(?: licen[sc]e condition)?"),
    ("dual", "dual", 3, 0.6, "dual licen[sc]ed(?: under)?|dual licen[sc]e"),
    ("commercial", "commercial", 3, 0.65, "(?:under a|a|obtain a|purchase a) commercial licen[sc]e"),
    # hints
    ("copyright", "copyright", 5, 0.35, "copyright (?:c|©|c)(?: ?[12][0-9]{3}(?: [12][0-9]{3})?)?"),
    ("copyright", "copyright", 5, 0.3, "(?:all )?content (?:is )?copyright|copyright of (?:the|its) (?:author|owner)s?"),
    ("copyright", "copyrighted", 5, 0.3, "copyrighted (?:material|work|by)"),
    ("license-hint", "licensed", 5, 0.2, "licensed (?:under|to you under|according to) (?:the|a|an)"),
    ("license-hint", "licenced", 5, 0.2, "licenced under (?:the|a|an)"),
    ("license-hint", "released", 5, 0.2, "released under (?:the|a|an)"),
    ("license-hint", "distributed", 5, 0.2, "distributed under (?:the|a|an)"),
    ("license-hint", "license", 5, 0.2, "see (?:the )?(?:accompanying )?(?:file )?license(?: file| txt| md)?"),
    ("license-hint", "licence", 5, 0.2, "see (?:the )?(?:accompanying )?(?:file )?licence(?: file| txt| md)?"),
    ("license-hint", "copying", 5, 0.2, "see (?:the )?(?:file )?copying(?: file)?(?: for details)"),
    ("license-hint", "terms", 5, 0.2, "terms of (?:use|service) apply|subject to (?:the|our|its) terms (?:of|and)"),
    ("license-hint", "permission", 5, 0.2, "(?:used|reprinted|reproduced) (?:with|by) permission"),
    ("license-hint", "courtesy", 5, 0.15, "(?:photo|image|text) courtesy of"),
)

#: Names, with and without versions.
NAMES = (
    ("apache-2", "apache", 3, 0.95, LEAD + "apache (?:software )?licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("apache-1.1", "apache", 3, 0.9, LEAD + "apache (?:software )?licen[sc]e (?:version |v ?)?1 1"),
    ("apache-1", "apache", 3, 0.9, LEAD + "apache (?:software )?licen[sc]e (?:version |v ?)?1 0"),
    ("apache-2", "apache", 3, 0.9, "apache 2(?: 0)?(?: licen[sc]ed?)?"),
    ("apache-2", "asl", 3, 0.8, "asl 2 0"),
    ("apache-2", "apache", 3, 0.9, "apache org licenses license 2 0"),
    ("apache", "apache", 4, 0.8, LEAD + "apache (?:software )?(?:foundation )?licen[sc]e"),
    ("apache", "apache", 4, 0.7, "apache (?:licensed|style licen[sc]e)"),
    ("mit", "mit", 4, 0.85, LEAD + "mit licen[sc]e"),
    ("mit", "mit", 4, 0.75, "mit (?:licen[sc]ed|style licen[sc]e|terms)"),
    ("mit", "mit", 3, 0.85, "opensource org licenses mit"),
    ("mit", "expat", 4, 0.85, LEAD + "expat licen[sc]e"),
    ("mit-0", "mit", 3, 0.85, "mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", 4, 0.85, LEAD + "(?:mit )?x11 licen[sc]e"),
    ("bsd-2", "bsd", 3, 0.9, LEAD + "(?:simplified|2 clause|two clause|freebsd) bsd licen[sc]e"),
    ("bsd-2", "bsd", 3, 0.9, "bsd (?:2|two) clause(?: simplified)?(?: licen[sc]e)?"),
    ("bsd-2", "freebsd", 3, 0.85, LEAD + "freebsd licen[sc]e"),
    ("bsd-3", "bsd", 3, 0.9, LEAD + "(?:new|revised|modified|3 clause|three clause) bsd licen[sc]e"),
    ("bsd-3", "bsd", 3, 0.9, "bsd (?:3|three) clause(?: new(?: or revised)?)?(?: licen[sc]e)?"),
    ("bsd-4", "bsd", 3, 0.9, LEAD + "(?:original|4 clause|four clause) bsd licen[sc]e"),
    ("bsd-4", "bsd", 3, 0.9, "bsd (?:4|four) clause(?: licen[sc]e)?"),
    ("bsd-0", "bsd", 3, 0.9, LEAD + "(?:zero|0) clause bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)?"),
    ("bsd-0", "0bsd", 3, 0.85, "0bsd"),
    ("bsd", "bsd", 4, 0.75, LEAD + "bsd (?:style |type )?licen[sc]ed?"),
    ("isc", "isc", 4, 0.85, LEAD + "isc licen[sc]e"),
    ("gpl-1", "gnu", 3, 0.9, LEAD + "gnu general public licen[sc]e (?:version |v ?)1(?: 0)?"),
    ("gpl-2-only", "only", 3, 0.95, LEAD + "(?:gnu general public licen[sc]e|gnu gpl|gpl) (?:version |v ?)?2(?: 0)? only"),
    ("gpl-2", "gnu", 3, 0.9, LEAD + "gnu general public licen[sc]e (?:gpl )?(?:version |v ?)?2(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-3-only", "only", 3, 0.95, LEAD + "(?:gnu general public licen[sc]e|gnu gpl|gpl) (?:version |v ?)?3(?: 0)? only"),
    ("gpl-3", "gnu", 3, 0.9, LEAD + "gnu general public licen[sc]e (?:gpl )?(?:version |v ?)?3(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-2", "gpl", 3, 0.9, LEAD + "(?:gnu )?gpl (?:version |v ?)?2(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-3", "gpl", 3, 0.9, LEAD + "(?:gnu )?gpl (?:version |v ?)?3(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-2", "gplv2", 3, 0.9, LEAD + "(?:gnu )?gplv2(?: or (?:any )?later)?"),
    ("gpl-3", "gplv3", 3, 0.9, LEAD + "(?:gnu )?gplv3(?: or (?:any )?later)?"),
    ("gpl-2", "gpl2", 3, 0.85, "gpl2"),
    ("gpl-3", "gpl3", 3, 0.85, "gpl3"),
    ("gpl", "gnu", 4, 0.7, LEAD + "gnu general public licen[sc]e"),
    ("gpl", "gnu", 4, 0.7, LEAD + "gnu gpl"),
    ("gpl", "gnu", 3, 0.75, "gnu org licenses gpl"),
    ("gpl", "gpl", 4, 0.6, "(?:licen[sc]ed|released|distributed) under (?:the )?gpl|gpl licen[sc]ed?"),
    ("lgpl-2", "library", 3, 0.9, LEAD + "gnu library general public licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("lgpl-2.1", "lesser", 3, 0.9, LEAD + "(?:gnu )?lesser general public licen[sc]e (?:version |v ?)?2 1(?: or (?:any )?later)?"),
    ("lgpl-3", "lesser", 3, 0.9, LEAD + "(?:gnu )?lesser general public licen[sc]e (?:version |v ?)?3(?: 0)?(?: or (?:any )?later)?"),
    ("lgpl-2", "lgpl", 3, 0.85, LEAD + "(?:gnu )?lgpl (?:version |v ?)?2 0"),
    ("lgpl-2.1", "lgpl", 3, 0.9, LEAD + "(?:gnu )?lgpl (?:version |v ?)?2 1(?: or (?:any )?later)?"),
    ("lgpl-3", "lgpl", 3, 0.9, LEAD + "(?:gnu )?lgpl (?:version |v ?)?3(?: 0)?(?: or (?:any )?later)?"),
    ("lgpl-2.1", "lgplv2", 3, 0.9, "lgplv2(?: 1)?"),
    ("lgpl-3", "lgplv3", 3, 0.9, "lgplv3"),
    ("lgpl", "lesser", 4, 0.75, LEAD + "(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "lgpl", 4, 0.7, LEAD + "(?:gnu )?lgpl"),
    ("agpl-3", "affero", 3, 0.9, LEAD + "(?:gnu )?affero general public licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?"),
    ("agpl-3", "agpl", 3, 0.85, LEAD + "(?:gnu )?agpl(?: (?:version |v ?)?3(?: 0)?)?"),
    ("agpl-3", "agplv3", 3, 0.9, LEAD + "(?:gnu )?agplv3"),
    ("agpl-1", "affero", 3, 0.85, "affero (?:inc )?general public licen[sc]e (?:version |v ?)?1"),
    ("gfdl", "documentation", 3, 0.9, LEAD + "gnu free documentation licen[sc]e(?: (?:version |v ?)?1 [123])?"),
    ("gfdl", "gfdl", 4, 0.75, "(?:gnu )?gfdl(?: 1 [123])?"),
    ("mpl-1", "mozilla", 3, 0.9, LEAD + "mozilla public licen[sc]e (?:version |v ?)?1 0"),
    ("mpl-1.1", "mozilla", 3, 0.9, LEAD + "mozilla public licen[sc]e (?:version |v ?)?1 1"),
    ("mpl-2", "mozilla", 3, 0.9, LEAD + "mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("mpl-1.1", "mpl", 3, 0.85, LEAD + "mpl (?:version |v ?)?1 1"),
    ("mpl-2", "mpl", 3, 0.85, LEAD + "mpl (?:version |v ?)?2(?: 0)?"),
    ("mpl-2", "mplv2", 3, 0.85, "mplv2(?: 0)?"),
    ("mpl", "mozilla", 4, 0.75, LEAD + "mozilla public licen[sc]e"),
    ("epl-1", "eclipse", 3, 0.9, LEAD + "eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?"),
    ("epl-2", "eclipse", 3, 0.9, LEAD + "eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("epl", "eclipse", 4, 0.75, LEAD + "eclipse public licen[sc]e"),
    ("edl", "eclipse", 4, 0.85, LEAD + "eclipse distribution licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("cddl-1.1", "development", 3, 0.9, LEAD + "common development and distribution licen[sc]e (?:cddl )?(?:version |v ?)?1 1"),
    ("cddl-1", "development", 3, 0.9, LEAD + "common development and distribution licen[sc]e(?: (?:cddl )?(?:version |v ?)?1 0)?"),
    ("cddl-1", "cddl", 4, 0.75, LEAD + "cddl(?: (?:version |v ?)?1 0)?"),
    ("cpl", "common", 3, 0.85, LEAD + "common public licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("cpal", "cpal", 3, 0.85, "common public attribution licen[sc]e cpal|cpal(?: 1 0)?"),
    ("ipl", "ibm", 3, 0.85, LEAD + "ibm public licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("artistic-1", "artistic", 3, 0.9, LEAD + "artistic licen[sc]e (?:version |v ?)?1(?: 0)?"),
    ("artistic-2", "artistic", 3, 0.9, LEAD + "artistic licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("artistic", "artistic", 4, 0.75, LEAD + "(?:perl )?artistic licen[sc]e"),
    ("zlib", "zlib", 4, 0.85, LEAD + "zlib (?:libpng )?licen[sc]e"),
    ("libpng", "libpng", 4, 0.85, LEAD + "(?:zlib )?libpng licen[sc]e(?: (?:version |v ?)2)?"),
    ("boost", "boost", 3, 0.9, LEAD + "boost software licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("python", "python", 3, 0.85, LEAD + "python software foundation licen[sc]e(?: (?:version |v ?)?2)?"),
    ("python", "psf", 4, 0.8, LEAD + "psf licen[sc]e"),
    ("python", "python", 4, 0.75, "python licen[sc]e"),
    ("php", "php", 3, 0.85, LEAD + "php licen[sc]e(?: (?:version |v ?)?3(?: 01| 0)?)?"),
    ("ruby", "ruby", 4, 0.8, LEAD + "ruby(?: s)? licen[sc]e"),
    ("openssl", "openssl", 4, 0.85, LEAD + "openssl licen[sc]e"),
    ("openssl", "ssleay", 4, 0.85, LEAD + "(?:original )?ssleay licen[sc]e"),
    ("unlicense", "unlicense", 4, 0.85, LEAD + "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", 4, 0.85, LEAD + "wtfpl(?: (?:version |v ?)?2)?"),
    ("wtfpl", "fuck", 3, 0.9, LEAD + "do what the fuck you want to public licen[sc]e"),
    ("beerware", "beerware", 4, 0.85, LEAD + "beerware licen[sc]e"),
    ("beerware", "beer", 4, 0.85, LEAD + "beer ware licen[sc]e"),
    ("ms-pl", "microsoft", 4, 0.85, LEAD + "microsoft public licen[sc]e"),
    ("ms-pl", "pl", 4, 0.75, LEAD + "ms pl"),
    ("ms-rl", "microsoft", 4, 0.85, LEAD + "microsoft reciprocal licen[sc]e"),
    ("ms-rl", "rl", 4, 0.75, LEAD + "ms rl"),
    ("eupl", "european", 3, 0.9, LEAD + "european union public licen[sc]e(?: (?:version |v ?)?1 [0-2])?"),
    ("eupl", "eupl", 3, 0.85, LEAD + "eupl(?: (?:version |v ?)?1 [0-2])?"),
    ("cecill", "cecill", 4, 0.85, LEAD + "cecill(?: free software)?(?: [abc])?(?: licen[sc]e)?(?: agreement)?"),
    ("osl", "open", 3, 0.85, LEAD + "open software licen[sc]e(?: (?:version |v ?)?[123](?: [01])?)?"),
    ("afl", "academic", 3, 0.85, LEAD + "academic free licen[sc]e(?: (?:version |v ?)?[123](?: [012])?)?"),
    ("ncsa", "ncsa", 4, 0.85, LEAD + "(?:university of illinois )?ncsa open source licen[sc]e"),
    ("ofl", "sil", 3, 0.9, LEAD + "sil open font licen[sc]e(?: (?:version |v ?)?1 [01])?"),
    ("ofl", "font", 4, 0.8, LEAD + "open font licen[sc]e"),
    ("unicode", "unicode", 4, 0.8, LEAD + "unicode (?:licen[sc]e(?: agreement| v3)?|data files and software licen[sc]e|terms of use)"),
    ("w3c", "w3c", 4, 0.8, LEAD + "w3c software (?:notice and |and document )?licen[sc]e"),
    ("vim", "vim", 4, 0.8, LEAD + "vim licen[sc]e"),
    ("tcl", "tcl", 4, 0.8, LEAD + "tcl (?:tk )?licen[sc]e"),
    ("postgresql", "postgresql", 4, 0.85, LEAD + "postgresql licen[sc]e"),
    ("sleepycat", "sleepycat", 4, 0.85, LEAD + "sleepycat licen[sc]e"),
    ("sspl", "server", 3, 0.85, LEAD + "server side public licen[sc]e(?: (?:version |v ?)?1)?"),
    ("sspl", "sspl", 4, 0.8, "sspl(?: 1 0)?"),
    ("busl", "business", 3, 0.85, LEAD + "business source licen[sc]e(?: (?:version |v ?)?1 1)?"),
    ("busl", "busl", 4, 0.8, "busl(?: 1 1)?"),
    ("elastic", "elastic", 3, 0.85, LEAD + "elastic licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("odbl", "database", 3, 0.85, LEAD + "(?:open data commons )?open database licen[sc]e(?: 1 0)?"),
    ("odbl", "odbl", 4, 0.75, "odbl(?: 1 0)?"),
    ("odc-by", "commons", 3, 0.85, LEAD + "open data commons attribution licen[sc]e(?: 1 0)?"),
    ("pddl", "dedication", 3, 0.85, LEAD + "(?:open data commons )?public domain dedication and licen[sc]e"),
    ("ogl", "government", 3, 0.85, LEAD + "open government licen[sc]e(?: (?:version |v ?)?[123](?: 0)?)?"),
    ("cdla", "community", 3, 0.85, "community data licen[sc]e agreement (?:permissive|sharing)"),
    ("cdla", "cdla", 4, 0.8, "cdla (?:permissive|sharing)"),
    ("mulan", "mulan", 3, 0.85, LEAD + "mulan (?:psl|permissive software licen[sc]e|public licen[sc]e)(?: v2)?"),
    ("mulan", "mulanpsl", 4, 0.8, "mulanpsl(?: 2 0)?"),
    ("llama", "llama", 3, 0.85, LEAD + "(?:meta )?llama (?:[234](?: [0-9])? )?community licen[sc]e(?: agreement)?"),
    ("gemma", "gemma", 3, 0.8, "gemma terms of use"),
    ("hippocratic", "hippocratic", 3, 0.85, LEAD + "hippocratic licen[sc]e"),
    ("parity", "parity", 3, 0.8, LEAD + "parity public licen[sc]e"),
    ("prosperity", "prosperity", 3, 0.8, LEAD + "prosperity public licen[sc]e"),
    ("blueoak", "blue", 3, 0.85, "blue oak model licen[sc]e(?: 1 0 0)?"),
    ("upl", "universal", 3, 0.8, LEAD + "universal permissive licen[sc]e(?: 1 0)?"),
    ("qpl", "qt", 3, 0.8, "qt public licen[sc]e|q public licen[sc]e qt"),
    ("lppl", "latex", 3, 0.85, LEAD + "latex project public licen[sc]e(?: 1 3c?)?"),
    ("lppl", "lppl", 4, 0.8, "lppl(?: 1 3c?)?"),
    ("aladdin", "aladdin", 3, 0.85, LEAD + "aladdin free public licen[sc]e"),
    ("rpl", "reciprocal", 3, 0.8, LEAD + "reciprocal public licen[sc]e(?: 1 5)?"),
    ("json", "evil", 2, 0.9, "the software shall be used for good not evil"),
    ("imagemagick", "imagemagick", 4, 0.8, LEAD + "imagemagick licen[sc]e"),
    ("curl", "curl", 4, 0.75, LEAD + "curl licen[sc]e"),
    ("ijg", "jpeg", 2, 0.8, "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", 4, 0.8, LEAD + "freetype (?:project )?licen[sc]e"),
    ("sun", "sun", 3, 0.75, LEAD + "sun public licen[sc]e(?: 1 0)?"),
    ("nasa", "nasa", 3, 0.8, LEAD + "nasa open source agreement(?: 1 3)?"),
    ("intel", "intel", 3, 0.75, LEAD + "intel (?:open source|simplified software) licen[sc]e"),
    ("kopimi", "kopimi", 4, 0.6, "kopimi"),
    ("copyleft", "copyleft", 5, 0.3, "copyleft"),
    ("open-source", "osi", 5, 0.3, "osi approved(?: licen[sc]e)?"),
    ("cc0", "cc0", 3, 0.9, LEAD + "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0", "zero", 3, 0.9, LEAD + "creative commons (?:cc )?zero(?: 1 0)?"),
    ("cc0", "publicdomain", 3, 0.9, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "publicdomain", 3, 0.85, "creativecommons org publicdomain mark 1 0"),
    ("creative-commons", "creative", 4, 0.6, LEAD + "(?:a )?creative commons(?: licen[sc]e)?"),
    ("creative-commons", "rights", 5, 0.3, "some rights reserved"),
)

#: SPDX identifiers and their labels; each is looked for after the tag that names it.
IDENTIFIERS = (
    "Apache-2.0 apache-2|Apache-1.1 apache-1.1|Apache-1.0 apache-1|MIT mit|MIT-0 mit-0|X11 x11|BSD-2-Clause bsd-2|BSD-3-Clause bsd-3|BSD-4-Clause bsd-4|0BSD bsd-0|ISC isc|"
    "GPL-1.0-only gpl-1|GPL-1.0-or-later gpl-1|GPL-2.0 gpl-2|GPL-2.0-only gpl-2-only|GPL-2.0-or-later gpl-2|GPL-3.0 gpl-3|GPL-3.0-only gpl-3-only|GPL-3.0-or-later gpl-3|"
    "LGPL-2.0-only lgpl-2|LGPL-2.0-or-later lgpl-2|LGPL-2.1 lgpl-2.1|LGPL-2.1-only lgpl-2.1|LGPL-2.1-or-later lgpl-2.1|LGPL-3.0-only lgpl-3|LGPL-3.0-or-later lgpl-3|"
    "AGPL-3.0 agpl-3|AGPL-3.0-only agpl-3|AGPL-3.0-or-later agpl-3|MPL-1.0 mpl-1|MPL-1.1 mpl-1.1|MPL-2.0 mpl-2|EPL-1.0 epl-1|EPL-2.0 epl-2|CDDL-1.0 cddl-1|CDDL-1.1 cddl-1.1|"
    "CPL-1.0 cpl|CPAL-1.0 cpal|IPL-1.0 ipl|Artistic-1.0 artistic-1|Artistic-2.0 artistic-2|Zlib zlib|Libpng libpng|BSL-1.0 boost|Python-2.0 python|PSF-2.0 python|PHP-3.01 php|Ruby ruby|"
    "OpenSSL openssl|Unlicense unlicense|WTFPL wtfpl|Beerware beerware|MS-PL ms-pl|MS-RL ms-rl|EUPL-1.1 eupl|EUPL-1.2 eupl|CECILL-2.1 cecill|CECILL-B cecill|OSL-3.0 osl|AFL-3.0 afl|"
    "NCSA ncsa|OFL-1.1 ofl|Unicode-DFS-2016 unicode|Unicode-3.0 unicode|W3C w3c|Vim vim|TCL tcl|PostgreSQL postgresql|Sleepycat sleepycat|SSPL-1.0 sspl|BUSL-1.1 busl|Elastic-2.0 elastic|"
    "ODbL-1.0 odbl|ODC-By-1.0 odc-by|PDDL-1.0 pddl|GFDL-1.3-only gfdl|GFDL-1.3-or-later gfdl|MulanPSL-2.0 mulan|CC0-1.0 cc0|BlueOak-1.0.0 blueoak|UPL-1.0 upl|LPPL-1.3c lppl|RPL-1.5 rpl|"
    "curl curl|IJG ijg|FTL freetype|HPND hpnd|QPL-1.0 qpl"
)

#: Creative Commons: label, elements of the name, spelled-out name
CREATIVE = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by-sa", "attribution share ?alike"),
    ("cc-by-nc", "by-nc", "attribution non ?commercial"),
    ("cc-by-nd", "by-nd", "attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "by-nc-sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)
