"""Signature rules of the licence scan, each written by hand.

A rule is (priority, label, keyword, pattern, relevance).  Patterns are regular expressions over
lower-case words with one space between; a rule is tried only where its keyword is a word of the text.
Smaller priorities are better: 1 identifiers, 2 sentences of licence texts, 3 names with a version,
4 grants, 5 bare names, 6 notices.
"""

from __future__ import annotations

RULES: tuple[tuple[int, str, str, str, float], ...] = (
    # identifiers
    (1, "mit", "identifier", "spdx license identifier mit", 1.0),
    (1, "mit-0", "identifier", "spdx license identifier mit 0", 1.0),
    (1, "apache-2.0", "identifier", "spdx license identifier apache 2 0", 1.0),
    (1, "apache-1.1", "identifier", "spdx license identifier apache 1 1", 1.0),
    (1, "gpl-2", "identifier", "spdx license identifier gpl 2 0(?: only)?", 1.0),
    (1, "gpl-2+", "identifier", "spdx license identifier gpl 2 0 or later", 1.0),
    (1, "gpl-3", "identifier", "spdx license identifier gpl 3 0(?: only)?", 1.0),
    (1, "gpl-3+", "identifier", "spdx license identifier gpl 3 0 or later", 1.0),
    (1, "lgpl-2.1", "identifier", "spdx license identifier lgpl 2 1(?: only)?", 1.0),
    (1, "lgpl-2.1+", "identifier", "spdx license identifier lgpl 2 1 or later", 1.0),
    (1, "lgpl-3", "identifier", "spdx license identifier lgpl 3 0(?: only)?", 1.0),
    (1, "lgpl-3+", "identifier", "spdx license identifier lgpl 3 0 or later", 1.0),
    (1, "agpl-3", "identifier", "spdx license identifier agpl 3 0(?: only)?", 1.0),
    (1, "agpl-3+", "identifier", "spdx license identifier agpl 3 0 or later", 1.0),
    (1, "bsd-2-clause", "identifier", "spdx license identifier bsd 2 clause", 1.0),
    (1, "bsd-3-clause", "identifier", "spdx license identifier bsd 3 clause", 1.0),
    (1, "bsd-4-clause", "identifier", "spdx license identifier bsd 4 clause", 1.0),
    (1, "0bsd", "identifier", "spdx license identifier 0bsd", 1.0),
    (1, "mpl-1.1", "identifier", "spdx license identifier mpl 1 1", 1.0),
    (1, "mpl-2.0", "identifier", "spdx license identifier mpl 2 0", 1.0),
    (1, "epl-1.0", "identifier", "spdx license identifier epl 1 0", 1.0),
    (1, "epl-2.0", "identifier", "spdx license identifier epl 2 0", 1.0),
    (1, "cddl-1.0", "identifier", "spdx license identifier cddl 1 0", 1.0),
    (1, "eupl-1.2", "identifier", "spdx license identifier eupl 1 2", 1.0),
    (1, "isc", "identifier", "spdx license identifier isc", 1.0),
    (1, "zlib", "identifier", "spdx license identifier zlib", 1.0),
    (1, "boost-1.0", "identifier", "spdx license identifier bsl 1 0", 1.0),
    (1, "unlicense", "identifier", "spdx license identifier unlicense", 1.0),
    (1, "wtfpl", "identifier", "spdx license identifier wtfpl", 1.0),
    (1, "cc0-1.0", "identifier", "spdx license identifier cc0 1 0", 1.0),
    (1, "cc-by-4.0", "identifier", "spdx license identifier cc by 4 0", 1.0),
    (1, "cc-by-sa-4.0", "identifier", "spdx license identifier cc by sa 4 0", 1.0),
    (1, "artistic-2.0", "identifier", "spdx license identifier artistic 2 0", 1.0),
    (1, "ofl-1.1", "identifier", "spdx license identifier ofl 1 1", 1.0),
    (1, "other", "identifier", "spdx license identifier", 0.6),
    # sentences of licence texts
    (2, "mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    (2, "mit", "merge", "to use copy modify merge publish distribute sublicense and or sell copies of the software", 1.0),
    (2, "mit", "noninfringement", "the warranties of merchantability fitness for a particular purpose and noninfringement", 0.9),
    (2, "mit", "substantial", "shall be included in all copies or substantial portions of the software", 1.0),
    (2, "mit", "holders", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.9),
    (2, "isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    (2, "isc", "disclaims", "the author disclaims all warranties with regard to this software", 0.9),
    (2, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    (2, "bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 1.0),
    (2, "bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 1.0),
    (2, "bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission", 1.0),
    (2, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display", 1.0),
    (2, "bsd", "contributors", "this software is provided by the copyright holders and contributors as is", 1.0),
    (2, "apache-2.0", "compliance", "you may not use this file except in compliance with the license", 0.9),
    (2, "apache-2.0", "perpetual", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 1.0),
    (2, "apache-2.0", "perpetual", "perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license", 1.0),
    (2, "apache-2.0", "unless", "unless required by applicable law or agreed to in writing software distributed under the license", 1.0),
    (2, "apache-2.0", "conditions", "without warranties or conditions of any kind either express or implied", 0.9),
    (2, "apache-1.1", "foundation", "this product includes software developed by the apache software foundation", 1.0),
    (2, "gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    (2, "gpl-2+", "later", "either version 2 of the license or at your option any later version", 1.0),
    (2, "lgpl-2.1+", "later", "either version 2 1 of the license or at your option any later version", 1.0),
    (2, "gpl-3+", "later", "either version 3 of the license or at your option any later version", 1.0),
    (2, "gpl", "useful", "this program is distributed in the hope that it will be useful but without any warranty", 1.0),
    (2, "lgpl", "useful", "this library is distributed in the hope that it will be useful but without any warranty", 1.0),
    (2, "lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0),
    (2, "gpl", "received", "you should have received a copy of the gnu general public license", 1.0),
    (2, "lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license", 1.0),
    (2, "agpl", "received", "you should have received a copy of the gnu affero general public license", 1.0),
    (2, "agpl", "affero", "under the terms of the gnu affero general public license", 1.0),
    (2, "gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document", 0.9),
    (2, "gpl-3", "convey", "you may convey verbatim copies of the program s source code as you receive it", 1.0),
    (2, "gpl-2", "verbatim", "you may copy and distribute verbatim copies of the program s source code as you receive it", 1.0),
    (2, "gpl-3", "copyleft", "the gnu general public license is a free copyleft license for software", 1.0),
    (2, "agpl-3", "remotely", "all users interacting with it remotely through a computer network", 1.0),
    (2, "mpl-1.1", "contents", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    (2, "mpl-2.0", "subject", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    (2, "mpl-2.0", "distributed", "if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    (2, "mpl-2.0", "incompatible", "this source code form is incompatible with secondary licenses", 1.0),
    (2, "epl-1.0", "accompanying", "the accompanying program is provided under the terms of this eclipse public license", 1.0),
    (2, "epl-2.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 1.0),
    (2, "epl-1.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 1.0),
    (2, "cddl-1.0", "contents", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    (2, "cpl-1.0", "accompanying", "the accompanying program is provided under the terms of this common public license", 1.0),
    (2, "zlib", "misrepresented", "the origin of this software must not be misrepresented", 1.0),
    (2, "zlib", "altered", "altered source versions must be plainly marked as such", 1.0),
    (2, "zlib", "implied", "this software is provided as is without any express or implied warranty", 0.9),
    (2, "boost-1.0", "machine", "solely in the form of machine executable object code generated by a source language processor", 1.0),
    (2, "boost-1.0", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 1.0),
    (2, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    (2, "unlicense", "publish", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    (2, "wtfpl", "fuck", "you just do what the fuck you want to", 1.0),
    (2, "cc0-1.0", "waived", "has waived all copyright and related or neighboring rights", 1.0),
    (2, "cc0-1.0", "dedicated", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide", 1.0),
    (2, "cc-by", "redistribute", "you are free to share copy and redistribute the material in any medium or format", 0.9),
    (2, "cc-by-sa", "transform", "if you remix transform or build upon the material you must distribute your contributions under the same license", 1.0),
    (2, "cc-by-nd", "transform", "if you remix transform or build upon the material you may not distribute the modified material", 1.0),
    (2, "cc-by-nc", "commercial", "you may not use the material for commercial purposes", 1.0),
    (2, "ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1", 1.0),
    (2, "ofl", "fonts", "the fonts and derivatives however cannot be released under any other type of license", 1.0),
    (2, "artistic-2.0", "artistic", "the terms of the artistic license 2 0", 1.0),
    (2, "artistic", "standard", "you may make and give away verbatim copies of the source form of the standard version", 1.0),
    (2, "postgresql", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", 0.9),
    (2, "python", "psf", "this license agreement is between the python software foundation psf", 1.0),
    (2, "php", "php", "this product includes php software freely available from", 1.0),
    (2, "openssl", "openssl", "this product includes software developed by the openssl project", 1.0),
    (2, "curl", "except", "except as contained in this notice the name of a copyright holder shall not be used in advertising", 0.9),
    (2, "beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 1.0),
    (2, "json", "evil", "the software shall be used for good not evil", 1.0),
    (2, "eupl", "eupl", "licensed under the eupl", 1.0),
    (2, "ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    # names with a version
    (3, "apache-2.0", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version| v)? v?2(?: 0)?", 0.9),
    (3, "apache-2.0", "apache", "apache(?: licen[cs]e)? v2(?: 0)?", 0.9),
    (3, "apache-1.1", "apache", "apache(?: software)? licen[cs]e(?: version| v)? v?1 1", 0.9),
    (3, "apache-1.0", "apache", "apache(?: software)? licen[cs]e(?: version| v)? v?1 0", 0.9),
    (3, "gpl-1", "general", "(?:gnu )?general public licen[cs]e(?: version| v)? v?1(?: 0)?", 0.9),
    (3, "gpl-2", "general", "(?:gnu )?general public licen[cs]e(?: version| v)? v?2(?: 0)?", 0.9),
    (3, "gpl-2", "general", "(?:gnu )?general public licen[cs]e v2(?: 0)?", 0.9),
    (3, "gpl-3", "general", "(?:gnu )?general public licen[cs]e(?: version| v)? v?3(?: 0)?", 0.9),
    (3, "gpl-3", "general", "(?:gnu )?general public licen[cs]e v3(?: 0)?", 0.9),
    (3, "gpl-2", "gplv2", "(?:gnu )?gplv2(?: 0)?(?: only)?", 0.9),
    (3, "gpl-2+", "gplv2", "(?:gnu )?gplv2(?: 0)? or later", 0.9),
    (3, "gpl-3", "gplv3", "(?:gnu )?gplv3(?: 0)?(?: only)?", 0.9),
    (3, "gpl-3+", "gplv3", "(?:gnu )?gplv3(?: 0)? or later", 0.9),
    (3, "gpl-2", "gpl2", "gpl2", 0.8),
    (3, "gpl-3", "gpl3", "gpl3", 0.8),
    (3, "gpl-2", "gpl", "(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? v?2(?: 0)?(?: only)?", 0.9),
    (3, "gpl-2+", "gpl", "(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? v?2(?: 0)? or later", 0.9),
    (3, "gpl-2", "gpl", "(?:gnu )?gpl v2(?: 0)?", 0.9),
    (3, "gpl-3", "gpl", "(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? v?3(?: 0)?(?: only)?", 0.9),
    (3, "gpl-3+", "gpl", "(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? v?3(?: 0)? or later", 0.9),
    (3, "gpl-3", "gpl", "(?:gnu )?gpl v3(?: 0)?", 0.9),
    (3, "lgpl-2", "library", "(?:gnu )?library general public licen[cs]e(?: version| v)? v?2(?: 0)?", 0.9),
    (3, "lgpl-2.1", "lesser", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? v?2 1", 0.9),
    (3, "lgpl-2.1", "lesser", "(?:gnu )?lesser general public licen[cs]e v2 1", 0.9),
    (3, "lgpl-3", "lesser", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? v?3(?: 0)?", 0.9),
    (3, "lgpl-3", "lesser", "(?:gnu )?lesser general public licen[cs]e v3(?: 0)?", 0.9),
    (3, "lgpl-2.1", "lgplv2", "(?:gnu )?lgplv2 1", 0.9),
    (3, "lgpl-2", "lgplv2", "(?:gnu )?lgplv2", 0.8),
    (3, "lgpl-3", "lgplv3", "(?:gnu )?lgplv3", 0.9),
    (3, "lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version| v)? v?2 1", 0.9),
    (3, "lgpl-2", "lgpl", "(?:gnu )?lgpl(?: version| v)? v?2(?: 0)?", 0.8),
    (3, "lgpl-3", "lgpl", "(?:gnu )?lgpl(?: version| v)? v?3(?: 0)?", 0.9),
    (3, "agpl-1", "affero", "affero general public licen[cs]e(?: version| v)? v?1(?: 0)?", 0.9),
    (3, "agpl-3", "affero", "(?:gnu )?affero general public licen[cs]e(?: version| v)? v?3(?: 0)?", 0.9),
    (3, "agpl-3", "affero", "(?:gnu )?affero general public licen[cs]e v3(?: 0)?", 0.9),
    (3, "agpl-3", "agplv3", "(?:gnu )?agplv3", 0.9),
    (3, "agpl-3", "agpl", "(?:gnu )?agpl(?: version| v)? v?3(?: 0)?", 0.9),
    (3, "fdl-1.2", "documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)? v?1 2", 0.9),
    (3, "fdl-1.3", "documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)? v?1 3", 0.9),
    (3, "bsd-2-clause", "bsd", "bsd(?: licen[cs]e)? (?:2|two) clause", 0.9),
    (3, "bsd-3-clause", "bsd", "bsd(?: licen[cs]e)? (?:3|three) clause", 0.9),
    (3, "bsd-4-clause", "bsd", "bsd(?: licen[cs]e)? (?:4|four) clause", 0.9),
    (3, "bsd-2-clause", "bsd", "(?:2|two) clause bsd", 0.9),
    (3, "bsd-3-clause", "bsd", "(?:3|three) clause bsd", 0.9),
    (3, "bsd-4-clause", "bsd", "(?:4|four) clause bsd", 0.9),
    (3, "bsd-2-clause", "bsd", "simplified bsd(?: licen[cs]e)?", 0.9),
    (3, "bsd-2-clause", "freebsd", "freebsd licen[cs]e", 0.8),
    (3, "bsd-3-clause", "bsd", "(?:new|modified|revised) bsd(?: licen[cs]e)?", 0.9),
    (3, "bsd-4-clause", "bsd", "(?:original|old) bsd(?: licen[cs]e)?", 0.9),
    (3, "0bsd", "bsd", "zero clause bsd", 0.9),
    (3, "0bsd", "0bsd", "0bsd", 0.9),
    (3, "mpl-1.0", "mozilla", "mozilla public licen[cs]e(?: version| v)? v?1 0", 0.9),
    (3, "mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: version| v)? v?1 1", 0.9),
    (3, "mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: version| v)? v?2(?: 0)?", 0.9),
    (3, "mpl-1.1", "mpl", "mpl(?: version| v)? v?1 1", 0.9),
    (3, "mpl-2.0", "mpl", "mpl(?: version| v)? v?2(?: 0)?", 0.9),
    (3, "mpl-2.0", "mplv2", "mplv2(?: 0)?", 0.9),
    (3, "epl-1.0", "eclipse", "eclipse public licen[cs]e(?: version| v)? v?1 0", 0.9),
    (3, "epl-2.0", "eclipse", "eclipse public licen[cs]e(?: version| v)? v?2 0", 0.9),
    (3, "epl-1.0", "epl", "epl(?: version| v)? v?1 0", 0.9),
    (3, "epl-2.0", "epl", "epl(?: version| v)? v?2 0", 0.9),
    (3, "cddl-1.0", "cddl", "cddl(?: version| v)? v?1 0", 0.9),
    (3, "cddl-1.1", "cddl", "cddl(?: version| v)? v?1 1", 0.9),
    (3, "cddl-1.0", "distribution", "common development and distribution licen[cs]e(?: version| v)? v?1 0", 0.9),
    (3, "cddl-1.1", "distribution", "common development and distribution licen[cs]e(?: version| v)? v?1 1", 0.9),
    (3, "cpl-1.0", "common", "common public licen[cs]e(?: version| v)? v?1 0", 0.9),
    (3, "eupl-1.1", "union", "european union public licen[cs]e(?: version| v)? v?1 1", 0.9),
    (3, "eupl-1.2", "union", "european union public licen[cs]e(?: version| v)? v?1 2", 0.9),
    (3, "eupl-1.1", "eupl", "eupl(?: version| v)? v?1 1", 0.9),
    (3, "eupl-1.2", "eupl", "eupl(?: version| v)? v?1 2", 0.9),
    (3, "artistic-1.0", "artistic", "artistic licen[cs]e(?: version| v)? v?1 0", 0.9),
    (3, "artistic-2.0", "artistic", "artistic licen[cs]e(?: version| v)? v?2 0", 0.9),
    (3, "boost-1.0", "boost", "boost software licen[cs]e(?: version| v)? v?1 0", 0.9),
    (3, "afl-2.1", "academic", "academic free licen[cs]e(?: version| v)? v?2 1", 0.9),
    (3, "afl-3.0", "academic", "academic free licen[cs]e(?: version| v)? v?3 0", 0.9),
    (3, "osl-2.1", "open", "open software licen[cs]e(?: version| v)? v?2 1", 0.9),
    (3, "osl-3.0", "open", "open software licen[cs]e(?: version| v)? v?3 0", 0.9),
    (3, "ofl-1.0", "sil", "sil open font licen[cs]e(?: version| v)? v?1 0", 0.9),
    (3, "ofl-1.1", "sil", "sil open font licen[cs]e(?: version| v)? v?1 1", 0.9),
    (3, "odbl-1.0", "database", "open database licen[cs]e(?: version| v)? v?1 0", 0.9),
    (3, "odbl-1.0", "odbl", "odbl(?: version| v)? v?1 0", 0.9),
    (3, "php-3.0", "php", "php licen[cs]e(?: version| v)? v?3 0", 0.9),
    (3, "php-3.01", "php", "php licen[cs]e(?: version| v)? v?3 01", 0.9),
    (3, "python-2.0", "python", "python software foundation licen[cs]e(?: version| v)? v?2(?: 0)?", 0.9),
    (3, "cc-by-2.0", "cc", "cc by 2 0", 0.9),
    (3, "cc-by-3.0", "cc", "cc by 3 0", 0.9),
    (3, "cc-by-4.0", "cc", "cc by 4 0", 0.9),
    (3, "cc-by-sa-2.0", "cc", "cc by sa 2 0", 0.9),
    (3, "cc-by-sa-3.0", "cc", "cc by sa 3 0", 0.9),
    (3, "cc-by-sa-4.0", "cc", "cc by sa 4 0", 0.9),
    (3, "cc-by-nd-4.0", "cc", "cc by nd 4 0", 0.9),
    (3, "cc-by-nc-3.0", "cc", "cc by nc 3 0", 0.9),
    (3, "cc-by-nc-4.0", "cc", "cc by nc 4 0", 0.9),
    (3, "cc-by-nc-sa-3.0", "cc", "cc by nc sa 3 0", 0.9),
    (3, "cc-by-nc-sa-4.0", "cc", "cc by nc sa 4 0", 0.9),
    (3, "cc-by-nc-nd-4.0", "cc", "cc by nc nd 4 0", 0.9),
    (3, "cc-by-3.0", "commons", "creative commons attribution 3 0", 0.9),
    (3, "cc-by-4.0", "commons", "creative commons attribution 4 0", 0.9),
    (3, "cc-by-sa-3.0", "commons", "creative commons attribution share ?alike 3 0", 0.9),
    (3, "cc-by-sa-4.0", "commons", "creative commons attribution share ?alike 4 0", 0.9),
    (3, "cc-by-nc-4.0", "commons", "creative commons attribution non ?commercial 4 0", 0.9),
    (3, "cc-by-nc-sa-4.0", "commons", "creative commons attribution non ?commercial share ?alike 4 0", 0.9),
    (3, "cc0-1.0", "cc0", "cc0(?: universal)? 1 0(?: universal)?", 0.9),
    # grants
    (4, "mit", "mit", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? mit(?: licen[cs]e)?", 1.0),
    (4, "apache", "apache", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? apache(?: software)?(?: licen[cs]e)?", 1.0),
    (4, "gpl", "general", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)?(?: gnu)? general public licen[cs]e", 1.0),
    (4, "gpl", "gpl", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)?(?: gnu)? gpl", 1.0),
    (4, "lgpl", "lgpl", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)?(?: gnu)? lgpl", 1.0),
    (4, "agpl", "agpl", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)?(?: gnu)? agpl", 1.0),
    (4, "bsd", "bsd", "(?:licen[cs]ed|released|distributed|available) under(?: a| the)?(?: terms of the)? bsd(?: style)?(?: licen[cs]e)?", 1.0),
    (4, "mpl", "mozilla", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? mozilla public licen[cs]e", 1.0),
    (4, "epl", "eclipse", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? eclipse public licen[cs]e", 1.0),
    (4, "isc", "isc", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? isc(?: licen[cs]e)?", 1.0),
    (4, "creative-commons", "commons", "(?:licen[cs]ed|released|distributed|available) under(?: a| the)?(?: terms of the)? creative commons(?: licen[cs]e)?", 0.9),
    (4, "dual", "dual", "dual licen[cs]ed under", 0.8),
    (4, "python", "python", "same terms as python(?: itself)?", 0.8),
    (4, "perl", "perl", "same terms as perl(?: itself)?", 0.8),
    # bare names
    (5, "mit", "mit", "mit licen[cs]e", 0.7),
    (5, "mit", "x11", "x11 licen[cs]e", 0.7),
    (5, "mit", "expat", "expat licen[cs]e", 0.7),
    (5, "apache", "apache", "apache(?: software)? licen[cs]e", 0.7),
    (5, "gpl", "general", "(?:gnu )?general public licen[cs]e", 0.7),
    (5, "gpl", "gpl", "(?:gnu )?gpl", 0.7),
    (5, "lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", 0.7),
    (5, "lgpl", "library", "(?:gnu )?library general public licen[cs]e", 0.7),
    (5, "lgpl", "lgpl", "(?:gnu )?lgpl", 0.7),
    (5, "agpl", "affero", "(?:gnu )?affero general public licen[cs]e", 0.7),
    (5, "agpl", "agpl", "(?:gnu )?agpl", 0.7),
    (5, "fdl", "documentation", "(?:gnu )?free documentation licen[cs]e", 0.7),
    (5, "bsd", "bsd", "bsd(?: style)? licen[cs]e", 0.7),
    (5, "bsd", "berkeley", "berkeley software distribution licen[cs]e", 0.7),
    (5, "mpl", "mozilla", "mozilla public licen[cs]e", 0.7),
    (5, "epl", "eclipse", "eclipse public licen[cs]e", 0.7),
    (5, "cddl", "distribution", "common development and distribution licen[cs]e", 0.7),
    (5, "cddl", "cddl", "cddl", 0.6),
    (5, "cpl", "common", "common public licen[cs]e", 0.7),
    (5, "eupl", "union", "european union public licen[cs]e", 0.7),
    (5, "artistic", "artistic", "artistic licen[cs]e", 0.7),
    (5, "isc", "isc", "isc licen[cs]e", 0.7),
    (5, "zlib", "zlib", "zlib(?: libpng)? licen[cs]e", 0.7),
    (5, "boost", "boost", "boost software licen[cs]e", 0.7),
    (5, "unlicense", "unlicense", "(?:the )?unlicense", 0.7),
    (5, "wtfpl", "wtfpl", "wtfpl", 0.7),
    (5, "osl", "open", "open software licen[cs]e", 0.6),
    (5, "afl", "academic", "academic free licen[cs]e", 0.7),
    (5, "ms-pl", "microsoft", "microsoft public licen[cs]e", 0.7),
    (5, "ms-rl", "reciprocal", "microsoft reciprocal licen[cs]e", 0.7),
    (5, "ofl", "font", "(?:sil )?open font licen[cs]e", 0.7),
    (5, "odbl", "database", "open database licen[cs]e", 0.7),
    (5, "python", "python", "python software foundation licen[cs]e", 0.7),
    (5, "ruby", "ruby", "ruby licen[cs]e", 0.6),
    (5, "php", "php", "php licen[cs]e", 0.6),
    (5, "postgresql", "postgresql", "postgresql licen[cs]e", 0.7),
    (5, "openssl", "openssl", "openssl licen[cs]e", 0.7),
    (5, "ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", 0.7),
    (5, "beerware", "beerware", "beerware licen[cs]e", 0.7),
    (5, "cc-by-sa", "cc", "cc by sa", 0.6),
    (5, "cc-by-nd", "cc", "cc by nd", 0.6),
    (5, "cc-by-nc", "cc", "cc by nc", 0.6),
    (5, "cc-by-nc-sa", "cc", "cc by nc sa", 0.6),
    (5, "cc-by-nc-nd", "cc", "cc by nc nd", 0.6),
    (5, "cc-by", "commons", "creative commons attribution", 0.7),
    (5, "cc-by-sa", "commons", "creative commons attribution share ?alike", 0.7),
    (5, "cc-by-nd", "commons", "creative commons attribution no ?derivatives", 0.7),
    (5, "cc-by-nc", "commons", "creative commons attribution non ?commercial", 0.7),
    (5, "cc0", "commons", "creative commons zero", 0.7),
    (5, "cc0", "cc0", "cc0", 0.6),
    (5, "creative-commons", "commons", "creative commons licen[cs]e", 0.6),
    # notices
    (6, "all-rights-reserved", "reserved", "all rights reserved", 0.6),
    (6, "some-rights-reserved", "reserved", "some rights reserved", 0.6),
    (6, "copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]", 0.5),
    (6, "public-domain", "domain", "(?:dedicated to|placed in|released into) the public domain", 0.9),
    (6, "public-domain", "domain", "public domain", 0.5),
    (6, "disclaimer", "warranty", "without warranty of any kind", 0.6),
    (6, "disclaimer", "warranty", "without any warranty", 0.5),
    (6, "disclaimer", "merchantability", "merchantability or fitness for a particular purpose", 0.6),
    (6, "proprietary", "proprietary", "proprietary and confidential", 0.8),
    (6, "proprietary", "proprietary", "confidential and proprietary", 0.8),
    (6, "proprietary", "reproduced", "may not be reproduced(?: in any form)? without(?: prior)? written permission", 0.8),
    (6, "proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|document|software) is strictly prohibited", 0.8),
    (6, "evaluation", "evaluation", "for evaluation purposes only", 0.5),
    (6, "permission", "permission", "used with permission", 0.4),
)

#: A text without any of these stems, and without "cc by", holds no rule's match and no base phrase.
GATE_STEMS = (
    "licen", "warrant", "redistribut", "permi", "copyright", "reserved", "domain", "commons", "proprietary", "apache", "bsd", "gpl", "mpl", "epl",
    "cddl", "eupl", "odbl", "wtfpl", "cc0", "substantial", "liab", "noninfring", "evaluation", "same", "verbatim", "merchantab", "solely", "free to copy",
    "altered", "misrepresented", "evil", "fonts", "beer", "fuck", "openssl", "php", "prohibited", "transform", "commercial", "waived", "advertising", "endorse", "is provided", "remotely", "under",
)
