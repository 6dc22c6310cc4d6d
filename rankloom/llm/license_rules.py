"""The signature rules of the licence scan, written by hand: label, priority, keywords, pattern, example.

Patterns run on lower-cased text.  In them a space is any white space, ~ is white space or none, {L} the word licence in
either spelling, {V} what may stand between a name and its version, and {v1} {v2} {v3} a version with or without ".0" that
no other digits follow.  One of the keywords, parted by |, is in every match once white space is made single spaces.
Priorities: 0 identifiers, 1 passages and grants, 2 names with a version, 3 names, 4 notices that name no licence.
"""

from __future__ import annotations

MACROS = {
    "{L}": r"licen[sc]e",
    "{V}": r"""(?:~\(?(?:the )?["']?licen[sc]e["']?\)?|~\([a-z]{2,5}\))?,?~(?:version|ver\.?|v\.?)?~""",
    "{v1}": r"1(?:\.0)?(?!\.?[0-9])",
    "{v2}": r"2(?:\.0)?(?!\.?[0-9])",
    "{v3}": r"3(?:\.0)?(?!\.?[0-9])",
}

RULES = (
    # Apache
    ("apache-2.0", 0, "spdx", r"spdx-license-identifier:~\(?apache-2\.0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", 1, "apache", r"licensed under (?:the )?apache {L}{V}{v2}", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 1, "apache", r"released under (?:the )?(?:terms of the )?apache(?: software)? {L}{V}{v2}", "released under the terms of the Apache License v2.0"),
    ("apache-2.0", 1, "apache", r"apache {L} version 2\.0, january 2004", "Apache License Version 2.0, January 2004"),
    ("apache-2.0", 1, "apache.org", r"(?:https?://)?(?:www\.)?apache\.org/licenses/license-2\.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", 1, "compliance", r"you may not use this file except in compliance with the {L}", "you may not use this file except in compliance with the License"),
    ("apache-2.0", 2, "apache", r"apache(?: software)? {L}{V}{v2}", "Apache License 2.0"),
    ("apache-2.0", 2, "apache", r"apache~-?~(?:v\.?~)?2(?:\.0)? {L}", "Apache 2.0 license"),
    ("apache-2.0", 2, "asl|al2", r"(?:asl~v?2(?:\.0)?|al2\.0)", "ASL 2.0"),
    ("apache-1.1", 0, "spdx", r"spdx-license-identifier:~\(?apache-1\.1", "SPDX-License-Identifier: Apache-1.1"),
    ("apache-1.1", 2, "apache", r"apache(?: software)? {L}{V}1\.1", "Apache Software License, Version 1.1"),
    ("apache-1.0", 0, "spdx", r"spdx-license-identifier:~\(?apache-1\.0", "SPDX-License-Identifier: Apache-1.0"),
    ("apache-1.0", 1, "apache", r"this product includes software developed by the apache group", "This product includes software developed by the Apache Group"),
    ("apache-1.1", 1, "apache", r"this product includes software developed by the apache software foundation", "This product includes software developed by the Apache Software Foundation"),
    ("apache", 3, "apache", r"apache(?: software)? {L}", "the Apache Software License"),
    # MIT and its kin
    ("mit", 0, "spdx", r"spdx-license-identifier:~\(?mit(?:-0)?", "SPDX-License-Identifier: MIT"),
    ("mit", 1, "hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", 1, "substantial portions", r"shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions of the Software"),
    ("mit", 1, "mit", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit {L}", "Released under the MIT License"),
    ("mit", 1, "opensource.org", r"opensource\.org/licenses?/mit", "https://opensource.org/licenses/MIT"),
    ("mit", 2, "license", r"license~[:=]~[\"']?mit", "License: MIT"),
    ("mit", 3, "mit", r"mit(?:/x11)?(?:-style)? {L}", "the MIT license"),
    ("mit", 3, "expat", r"expat {L}", "Expat license"),
    ("x11", 0, "spdx", r"spdx-license-identifier:~\(?x11", "SPDX-License-Identifier: X11"),
    ("x11", 1, "x consortium", r"the name of the x consortium shall not be used in advertising", "the name of the X Consortium shall not be used in advertising"),
    ("x11", 3, "x11", r"x11 {L}", "X11 License"),
    ("hpnd", 1, "permission to use, copy", r"permission to use, copy, modify,? and distribute this software and its (?:supporting )?documentation for any purpose", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose"),
    ("hpnd", 1, "permission to use, copy", r"permission to use, copy, modify,? and distribute this software and its documentation", "Permission to use, copy, modify and distribute this software and its documentation"),
    ("isc", 0, "spdx", r"spdx-license-identifier:~\(?isc", "SPDX-License-Identifier: ISC"),
    ("isc", 1, "permission to use, copy", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("isc", 1, "isc", r"(?:licensed|released) under the isc {L}", "licensed under the ISC license"),
    ("isc", 3, "isc", r"isc {L}", "ISC License"),
    ("mit-0", 3, "no attribution", r"mit no attribution(?: {L})?", "MIT No Attribution"),
    # BSD
    ("bsd-2-clause", 0, "spdx", r"spdx-license-identifier:~\(?bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", 0, "spdx", r"spdx-license-identifier:~\(?bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd-4-clause", 0, "spdx", r"spdx-license-identifier:~\(?bsd-4-clause", "SPDX-License-Identifier: BSD-4-Clause"),
    ("0bsd", 0, "spdx", r"spdx-license-identifier:~\(?0bsd", "SPDX-License-Identifier: 0BSD"),
    ("bsd", 1, "redistribution and use", r"redistribution and use in source and binary forms", "Redistribution and use in source and binary forms"),
    ("bsd-3-clause", 1, "endorse or promote", r"neither the names? of (?s:.){1,120}? may be used to endorse or promote products", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 1, "advertising materials", r"all advertising materials mentioning features or use of this software must display", "All advertising materials mentioning features or use of this software must display"),
    ("bsd", 1, "bsd", r"(?:licensed|released|distributed) under (?:the |a )?(?:terms of the )?bsd(?:-style)? {L}", "distributed under the terms of the BSD license"),
    ("bsd-2-clause", 2, "bsd", r"(?:2|two)[ -]clause bsd(?: {L})?", "2-clause BSD license"),
    ("bsd-2-clause", 2, "bsd", r"bsd[ -](?:2|two)[ -]clause(?: {L})?", "BSD 2-Clause License"),
    ("bsd-2-clause", 2, "bsd", r"(?:simplified bsd|freebsd) {L}", "Simplified BSD License"),
    ("bsd-3-clause", 2, "bsd", r"(?:3|three)[ -]clause bsd(?: {L})?", "three-clause BSD"),
    ("bsd-3-clause", 2, "bsd", r"bsd[ -](?:3|three)[ -]clause(?: {L})?", "BSD 3-Clause License"),
    ("bsd-3-clause", 2, "bsd", r"(?:new|modified|revised) bsd(?: {L})?", "New BSD License"),
    ("bsd-4-clause", 2, "bsd", r"(?:(?:4|four)[ -]clause|original) bsd(?: {L})?", "original BSD license"),
    ("0bsd", 2, "bsd", r"zero[ -]clause bsd(?: {L})?", "Zero-Clause BSD"),
    ("bsd", 3, "bsd", r"bsd(?:-style)? {L}", "BSD-style license"),
    # GNU; versions 2.0 and 2.1 of the lesser licence share a label
    ("gpl-1.0", 0, "spdx", r"spdx-license-identifier:~\(?gpl-1\.0(?:-only|-or-later|\+)?", "SPDX-License-Identifier: GPL-1.0-or-later"),
    ("gpl-2.0", 0, "spdx", r"spdx-license-identifier:~\(?gpl-2\.0(?:-only|-or-later|\+)?", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl-3.0", 0, "spdx", r"spdx-license-identifier:~\(?gpl-3\.0(?:-only|-or-later|\+)?", "SPDX-License-Identifier: GPL-3.0+"),
    ("gpl", 1, "free software foundation", r"under the terms of the gnu general public {L} as published by the free software foundation", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", 1, "gnu general public", r"you should have received a copy of the gnu general public {L}", "You should have received a copy of the GNU General Public License"),
    ("gpl-2.0", 1, "june 1991", r"gnu general public {L} version 2, june 1991", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-3.0", 1, "june 2007", r"gnu general public {L} version 3, 29 june 2007", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-2.0", 1, "option", r"either version 2 of the {L}, or~\(?at your option\)? any later version", "either version 2 of the License, or (at your option) any later version"),
    ("gpl-3.0", 1, "option", r"either version 3 of the {L}, or~\(?at your option\)? any later version", "either version 3 of the License, or (at your option) any later version"),
    ("gpl", 1, "gpl", r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?gpl", "released under the GPL"),
    ("gpl-1.0", 2, "general public", r"(?:gnu )?general public {L}{V}{v1}", "GNU General Public License version 1"),
    ("gpl-2.0", 2, "general public", r"(?:gnu )?general public {L}{V}{v2}", "GNU General Public License v2"),
    ("gpl-3.0", 2, "general public", r"(?:gnu )?general public {L}{V}{v3}", "General Public License (GPL) version 3"),
    ("gpl-2.0", 2, "gpl", r"(?:gnu )?gpl,?~-?(?:version|v\.?)?~{v2}\+?", "GNU GPLv2"),
    ("gpl-3.0", 2, "gpl", r"(?:gnu )?gpl,?~-?(?:version|v\.?)?~{v3}\+?", "GNU GPLv3"),
    ("gpl", 3, "gnu general public", r"gnu general public {L}", "GNU General Public Licence"),
    ("gpl", 3, "gnu gpl", r"gnu gpl", "the GNU GPL"),
    ("gpl", 1, "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl(?:-[0-9.]+)?(?:\.html|\.txt)?", "https://www.gnu.org/licenses/gpl.html"),
    ("gpl-classpath", 3, "classpath exception", r"classpath exception", "with the Classpath Exception"),
    ("lgpl-2.1", 0, "spdx", r"spdx-license-identifier:~\(?lgpl-2\.0(?:-only|-or-later|\+)?", "SPDX-License-Identifier: LGPL-2.0+"),
    ("lgpl-2.1", 0, "spdx", r"spdx-license-identifier:~\(?lgpl-2\.1(?:-only|-or-later|\+)?", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl-3.0", 0, "spdx", r"spdx-license-identifier:~\(?lgpl-3\.0(?:-only|-or-later|\+)?", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("lgpl", 1, "lesser general public", r"under the terms of the gnu lesser general public {L} as published by the free software foundation", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", 1, "library general public", r"under the terms of the gnu library general public {L} as published by the free software foundation", "under the terms of the GNU Library General Public License as published by the Free Software Foundation"),
    ("lgpl-2.1", 1, "february 1999", r"gnu lesser general public {L} version 2\.1, february 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl", 1, "lgpl", r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?lgpl", "distributed under the LGPL"),
    ("lgpl-2.1", 2, "library", r"(?:gnu )?library general public {L}{V}{v2}", "GNU Library General Public License version 2"),
    ("lgpl-2.1", 2, "lesser", r"(?:gnu )?lesser general public {L}{V}2\.1", "GNU Lesser General Public License version 2.1"),
    ("lgpl-3.0", 2, "lesser", r"(?:gnu )?lesser general public {L}{V}{v3}", "GNU Lesser General Public License v3"),
    ("lgpl-2.1", 2, "lgpl", r"(?:gnu )?lgpl,?~-?(?:version|v\.?)?~{v2}\+?", "LGPLv2"),
    ("lgpl-2.1", 2, "lgpl", r"(?:gnu )?lgpl,?~-?(?:version|v\.?)?~2\.1\+?", "GNU LGPL v2.1"),
    ("lgpl-3.0", 2, "lgpl", r"(?:gnu )?lgpl,?~-?(?:version|v\.?)?~{v3}\+?", "LGPL-3"),
    ("lgpl", 3, "lesser", r"(?:gnu )?lesser general public {L}", "GNU Lesser General Public License"),
    ("lgpl", 3, "library", r"(?:gnu )?library general public {L}", "GNU Library General Public License"),
    ("lgpl", 3, "gnu lgpl", r"gnu lgpl", "the GNU LGPL"),
    ("agpl-3.0", 0, "spdx", r"spdx-license-identifier:~\(?agpl-3\.0(?:-only|-or-later|\+)?", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("agpl-1.0", 0, "spdx", r"spdx-license-identifier:~\(?agpl-1\.0(?:-only|-or-later)?", "SPDX-License-Identifier: AGPL-1.0-only"),
    ("agpl-3.0", 1, "affero", r"under the terms of the gnu affero general public {L}", "under the terms of the GNU Affero General Public License"),
    ("agpl-3.0", 2, "affero", r"(?:gnu )?affero general public {L}{V}{v3}", "GNU Affero General Public License, version 3"),
    ("agpl-1.0", 2, "affero", r"affero general public {L}{V}{v1}", "Affero General Public License version 1"),
    ("agpl-3.0", 2, "agpl", r"(?:gnu )?agpl,?~-?(?:version|v\.?)?~{v3}\+?", "AGPLv3"),
    ("agpl", 3, "affero", r"(?:gnu )?affero general public {L}", "Affero General Public License"),
    ("agpl", 3, "gnu agpl", r"gnu agpl", "GNU AGPL"),
    ("gfdl-1.3", 0, "spdx", r"spdx-license-identifier:~\(?gfdl-1\.3(?:-only|-or-later)?", "SPDX-License-Identifier: GFDL-1.3-or-later"),
    ("gfdl-1.2", 0, "spdx", r"spdx-license-identifier:~\(?gfdl-1\.2(?:-only|-or-later)?", "SPDX-License-Identifier: GFDL-1.2-only"),
    ("gfdl-1.1", 0, "spdx", r"spdx-license-identifier:~\(?gfdl-1\.1(?:-only|-or-later)?", "SPDX-License-Identifier: GFDL-1.1-only"),
    ("gfdl", 1, "invariant sections", r"with (?:no|the) invariant sections", "with no Invariant Sections"),
    ("gfdl-1.3", 2, "free documentation", r"(?:gnu )?free documentation {L}{V}1\.3", "GNU Free Documentation License, Version 1.3"),
    ("gfdl-1.2", 2, "free documentation", r"(?:gnu )?free documentation {L}{V}1\.2", "GNU Free Documentation License 1.2"),
    ("gfdl", 3, "free documentation", r"(?:gnu )?free documentation {L}", "GNU Free Documentation License"),
    ("gfdl", 3, "gfdl", r"gfdl", "the GFDL"),
    # Mozilla, Eclipse and others of their kind
    ("mpl-1.0", 0, "spdx", r"spdx-license-identifier:~\(?mpl-1\.0", "SPDX-License-Identifier: MPL-1.0"),
    ("mpl-1.1", 0, "spdx", r"spdx-license-identifier:~\(?mpl-1\.1", "SPDX-License-Identifier: MPL-1.1"),
    ("mpl-2.0", 0, "spdx", r"spdx-license-identifier:~\(?mpl-2\.0", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl-2.0", 1, "mozilla", r"this source code form is subject to the terms of the mozilla public {L}", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("mpl-1.1", 1, "mozilla", r"the contents of this file are subject to the mozilla public {L} version 1\.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("mpl-2.0", 1, "mozilla.org", r"mozilla\.org/mpl/2\.0", "http://mozilla.org/MPL/2.0/"),
    ("mpl-1.0", 2, "mozilla", r"mozilla public {L}{V}{v1}", "Mozilla Public License 1.0"),
    ("mpl-1.1", 2, "mozilla", r"mozilla public {L}{V}1\.1", "Mozilla Public License, Version 1.1"),
    ("mpl-2.0", 2, "mozilla", r"mozilla public {L}{V}{v2}", "Mozilla Public License 2.0"),
    ("mpl-2.0", 2, "mpl", r"mpl~-?v?~2\.0", "MPL 2.0"),
    ("mpl", 3, "mozilla", r"mozilla public {L}", "Mozilla Public License"),
    ("npl-1.1", 3, "netscape", r"netscape public {L}", "Netscape Public License"),
    ("epl-1.0", 0, "spdx", r"spdx-license-identifier:~\(?epl-1\.0", "SPDX-License-Identifier: EPL-1.0"),
    ("epl-2.0", 0, "spdx", r"spdx-license-identifier:~\(?epl-2\.0", "SPDX-License-Identifier: EPL-2.0"),
    ("epl-1.0", 1, "eclipse", r"made available under the terms of the eclipse public {L} v1\.0", "made available under the terms of the Eclipse Public License v1.0"),
    ("epl-2.0", 1, "eclipse", r"made available under the terms of the eclipse public {L} 2\.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("epl-1.0", 2, "eclipse", r"eclipse public {L}{V}{v1}", "Eclipse Public License, v 1.0"),
    ("epl-2.0", 2, "eclipse", r"eclipse public {L}{V}{v2}", "Eclipse Public License 2.0"),
    ("epl", 3, "eclipse", r"eclipse public {L}", "Eclipse Public License"),
    ("edl-1.0", 3, "eclipse", r"eclipse distribution {L}", "Eclipse Distribution License"),
    ("cpl-1.0", 0, "spdx", r"spdx-license-identifier:~\(?cpl-1\.0", "SPDX-License-Identifier: CPL-1.0"),
    ("cpl-1.0", 3, "common public", r"common public {L}(?!~attribution)", "Common Public License"),
    ("cpal-1.0", 3, "common public attribution", r"common public attribution {L}", "Common Public Attribution License"),
    ("ibm-pl-1.0", 3, "ibm public", r"ibm public {L}", "IBM Public License"),
    ("cddl-1.0", 0, "spdx", r"spdx-license-identifier:~\(?cddl-1\.0", "SPDX-License-Identifier: CDDL-1.0"),
    ("cddl-1.1", 0, "spdx", r"spdx-license-identifier:~\(?cddl-1\.1", "SPDX-License-Identifier: CDDL-1.1"),
    ("cddl-1.1", 2, "common development", r"common development and distribution {L}{V}1\.1", "Common Development and Distribution License 1.1"),
    ("cddl-1.0", 3, "common development", r"common development and distribution {L}", "Common Development and Distribution License"),
    ("cddl-1.0", 3, "cddl", r"cddl", "the CDDL"),
    ("eupl-1.1", 0, "spdx", r"spdx-license-identifier:~\(?eupl-1\.1", "SPDX-License-Identifier: EUPL-1.1"),
    ("eupl-1.2", 0, "spdx", r"spdx-license-identifier:~\(?eupl-1\.2", "SPDX-License-Identifier: EUPL-1.2"),
    ("eupl-1.1", 2, "european union public", r"european union public {L}{V}1\.1", "European Union Public Licence, version 1.1"),
    ("eupl-1.2", 3, "european union public", r"european union public {L}", "European Union Public Licence"),
    ("cecill-2.1", 0, "spdx", r"spdx-license-identifier:~\(?cecill-2\.1", "SPDX-License-Identifier: CECILL-2.1"),
    ("cecill", 3, "cecill", r"cecill(?:-[bc])?(?: {L})?", "CeCILL-B license"),
    ("osl-3.0", 0, "spdx", r"spdx-license-identifier:~\(?osl-3\.0", "SPDX-License-Identifier: OSL-3.0"),
    ("osl-3.0", 3, "open software", r"open software {L}", "Open Software License"),
    ("afl-3.0", 0, "spdx", r"spdx-license-identifier:~\(?afl-3\.0", "SPDX-License-Identifier: AFL-3.0"),
    ("afl-3.0", 3, "academic free", r"academic free {L}", "Academic Free License"),
    ("ecl-2.0", 3, "educational community", r"educational community {L}", "Educational Community License"),
    ("qpl-1.0", 3, "q public", r"q public {L}", "Q Public License"),
    ("rpl-1.5", 3, "reciprocal public", r"reciprocal public {L}", "Reciprocal Public License"),
    ("apsl-2.0", 3, "apple public source", r"apple public source {L}", "Apple Public Source License"),
    ("sissl", 3, "sun industry", r"sun industry standards source {L}", "Sun Industry Standards Source License"),
    ("spl-1.0", 3, "sun public", r"sun public {L}", "Sun Public License"),
    ("nposl-3.0", 3, "non-profit", r"non-profit open software {L}", "Non-Profit Open Software License"),
    ("mulan-psl-2.0", 0, "spdx", r"spdx-license-identifier:~\(?mulanpsl-2\.0", "SPDX-License-Identifier: MulanPSL-2.0"),
    ("mulan-psl-2.0", 3, "mulan", r"mulan permissive software {L}", "Mulan Permissive Software License"),
    # Perl, Python, Ruby and other languages' own
    ("artistic-1.0", 0, "spdx", r"spdx-license-identifier:~\(?artistic-1\.0(?:-perl)?", "SPDX-License-Identifier: Artistic-1.0-Perl"),
    ("artistic-2.0", 0, "spdx", r"spdx-license-identifier:~\(?artistic-2\.0", "SPDX-License-Identifier: Artistic-2.0"),
    ("artistic-2.0", 2, "artistic", r"artistic {L}{V}{v2}", "Artistic License 2.0"),
    ("artistic", 3, "artistic", r"artistic {L}", "the Artistic License"),
    ("perl", 1, "perl itself", r"under the same terms as perl itself", "under the same terms as Perl itself"),
    ("python-2.0", 0, "spdx", r"spdx-license-identifier:~\(?(?:python|psf)-2\.0", "SPDX-License-Identifier: Python-2.0"),
    ("python-2.0", 3, "python", r"python software foundation {L}", "Python Software Foundation License"),
    ("python-2.0", 3, "psf", r"psf {L}", "PSF license"),
    ("ruby", 0, "spdx", r"spdx-license-identifier:~\(?ruby", "SPDX-License-Identifier: Ruby"),
    ("ruby", 3, "ruby", r"ruby(?:'s)? {L}", "Ruby license"),
    ("php-3.01", 0, "spdx", r"spdx-license-identifier:~\(?php-3\.01", "SPDX-License-Identifier: PHP-3.01"),
    ("php-3.01", 3, "php", r"php {L}", "The PHP License"),
    ("tcl", 3, "tcl", r"tcl(?:/tk)? {L}", "Tcl/Tk License"),
    ("zpl-2.1", 3, "zope", r"zope public {L}", "Zope Public License"),
    ("lppl-1.3c", 0, "spdx", r"spdx-license-identifier:~\(?lppl-1\.3c", "SPDX-License-Identifier: LPPL-1.3c"),
    ("lppl-1.3c", 3, "latex project", r"latex project public {L}", "LaTeX Project Public License"),
    ("vim", 3, "vim", r"vim {L}", "Vim license"),
    # Libraries and tools
    ("boost-1.0", 0, "spdx", r"spdx-license-identifier:~\(?bsl-1\.0", "SPDX-License-Identifier: BSL-1.0"),
    ("boost-1.0", 1, "boost", r"distributed under the boost software {L}", "Distributed under the Boost Software License"),
    ("boost-1.0", 3, "boost", r"boost software {L}", "Boost Software License"),
    ("zlib", 0, "spdx", r"spdx-license-identifier:~\(?zlib", "SPDX-License-Identifier: Zlib"),
    ("zlib", 1, "as-is", r"this software is provided ['\"]as-is['\"], without any express or implied", "This software is provided 'as-is', without any express or implied"),
    ("zlib", 1, "misrepresented", r"the origin of this software must not be misrepresented", "The origin of this software must not be misrepresented"),
    ("zlib", 3, "zlib", r"zlib(?:/libpng)? {L}", "zlib/libpng license"),
    ("libpng-2.0", 3, "libpng", r"png reference library {L}|libpng {L}", "libpng license"),
    ("openssl", 0, "spdx", r"spdx-license-identifier:~\(?openssl", "SPDX-License-Identifier: OpenSSL"),
    ("openssl", 1, "openssl", r"includes software developed by the openssl project", "This product includes software developed by the OpenSSL Project"),
    ("openssl", 3, "openssl", r"openssl {L}", "OpenSSL License"),
    ("ncsa", 0, "spdx", r"spdx-license-identifier:~\(?ncsa", "SPDX-License-Identifier: NCSA"),
    ("ncsa", 3, "illinois", r"university of illinois/ncsa open source {L}", "University of Illinois/NCSA Open Source License"),
    ("postgresql", 0, "spdx", r"spdx-license-identifier:~\(?postgresql", "SPDX-License-Identifier: PostgreSQL"),
    ("postgresql", 3, "postgresql", r"postgresql {L}", "PostgreSQL Licence"),
    ("curl", 0, "spdx", r"spdx-license-identifier:~\(?curl", "SPDX-License-Identifier: curl"),
    ("unicode", 3, "unicode", r"unicode(?:,? inc\.?)? {L}", "Unicode License"),
    ("icu", 3, "icu", r"icu {L}", "ICU License"),
    ("w3c", 3, "w3c", r"w3c(?:\(r\)|\xc2\xae)? software(?: notice and)? {L}", "W3C Software Notice and License"),
    ("ijg", 1, "independent jpeg", r"based in part on the work of the independent jpeg group", "this software is based in part on the work of the Independent JPEG Group"),
    ("sleepycat", 3, "sleepycat", r"sleepycat {L}", "Sleepycat License"),
    ("ms-pl", 0, "spdx", r"spdx-license-identifier:~\(?ms-pl", "SPDX-License-Identifier: MS-PL"),
    ("ms-pl", 3, "microsoft", r"microsoft public {L}", "Microsoft Public License"),
    ("ms-rl", 3, "microsoft", r"microsoft reciprocal {L}", "Microsoft Reciprocal License"),
    ("upl-1.0", 3, "universal permissive", r"universal permissive {L}", "Universal Permissive License"),
    ("blueoak-1.0.0", 3, "blue oak", r"blue oak model {L}", "Blue Oak Model License"),
    ("beerware", 3, "beer", r"beer-?~ware {L}", "Beerware license"),
    # Public domain and its kin
    ("unlicense", 0, "spdx", r"spdx-license-identifier:~\(?unlicense", "SPDX-License-Identifier: Unlicense"),
    ("unlicense", 1, "unencumbered", r"this is free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain"),
    ("unlicense", 3, "unlicense", r"(?:the )?unlicense", "the Unlicense"),
    ("wtfpl", 0, "spdx", r"spdx-license-identifier:~\(?wtfpl", "SPDX-License-Identifier: WTFPL"),
    ("wtfpl", 3, "what the fuck", r"do what the fuck you want to(?: public {L})?", "Do What The Fuck You Want To Public License"),
    ("wtfpl", 3, "wtfpl", r"wtfpl", "WTFPL"),
    ("public-domain", 1, "public domain", r"(?:has been |is |are )?(?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain", "has been placed in the public domain"),
    ("public-domain", 3, "public domain", r"(?:in|into|to) the public domain", "this work is in the public domain"),
    # Creative Commons and open data
    ("cc0-1.0", 0, "spdx", r"spdx-license-identifier:~\(?cc0-1\.0", "SPDX-License-Identifier: CC0-1.0"),
    ("cc0-1.0", 1, "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("cc0-1.0", 2, "cc0", r"cc0(?:[ -]1\.0)?(?: universal)?", "CC0 1.0 Universal"),
    ("cc-by-4.0", 0, "spdx", r"spdx-license-identifier:~\(?cc-by-4\.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("cc-by-sa", 0, "spdx", r"spdx-license-identifier:~\(?cc-by-sa-[1-4]\.[05]", "SPDX-License-Identifier: CC-BY-SA-3.0"),
    ("cc-by-nc", 0, "spdx", r"spdx-license-identifier:~\(?cc-by-nc-[1-4]\.[05]", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("cc-by-nd", 0, "spdx", r"spdx-license-identifier:~\(?cc-by-nd-[1-4]\.[05]", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    ("cc-by-4.0", 1, "creativecommons.org", r"creativecommons\.org/licenses/by/4\.0", "https://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-sa", 1, "creativecommons.org", r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]", "http://creativecommons.org/licenses/by-sa/3.0/"),
    ("cc-by-nc", 1, "creativecommons.org", r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]", "http://creativecommons.org/licenses/by-nc/2.5/"),
    ("cc-by-nc-sa", 1, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]", "http://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ("cc-by-nc-nd", 1, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]", "http://creativecommons.org/licenses/by-nc-nd/4.0/"),
    ("cc-by-nd", 1, "creativecommons.org", r"creativecommons\.org/licenses/by-nd/[1-4]\.[05]", "http://creativecommons.org/licenses/by-nd/4.0/"),
    ("cc-by-4.0", 2, "cc by|cc-by", r"cc[ -]by[ -]4\.0", "CC BY 4.0"),
    ("cc-by-3.0", 2, "cc by|cc-by", r"cc[ -]by[ -]3\.0", "CC BY 3.0"),
    ("cc-by-2.0", 2, "cc by|cc-by", r"cc[ -]by[ -]2\.[05]", "CC BY 2.0"),
    ("cc-by-nc-sa", 2, "cc by-nc-sa|cc-by-nc-sa", r"cc[ -]by-nc-sa(?:[ -][1-4]\.[05])?", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", 2, "cc by-nc-nd|cc-by-nc-nd", r"cc[ -]by-nc-nd(?:[ -][1-4]\.[05])?", "CC BY-NC-ND 4.0"),
    ("cc-by-sa", 3, "cc by-sa|cc-by-sa", r"cc[ -]by-sa(?:[ -][1-4]\.[05])?", "CC BY-SA 3.0"),
    ("cc-by-nc", 3, "cc by-nc|cc-by-nc", r"cc[ -]by-nc(?!-)(?:[ -][1-4]\.[05])?", "CC BY-NC 4.0"),
    ("cc-by-nd", 3, "cc by-nd|cc-by-nd", r"cc[ -]by-nd(?:[ -][1-4]\.[05])?", "CC BY-ND"),
    ("cc", 3, "creative commons", r"creative commons(?: attribution)?(?:[ -](?:share~-?alike|non-?commercial|no~-?derivatives|no~-?derivs))*(?: [1-4]\.[05])?(?: international| unported)?(?: public)? {L}", "Creative Commons License"),
    ("odbl-1.0", 0, "spdx", r"spdx-license-identifier:~\(?odbl-1\.0", "SPDX-License-Identifier: ODbL-1.0"),
    ("odbl-1.0", 3, "open database", r"(?:open data commons )?open database {L}", "Open Database License"),
    ("odc-by-1.0", 3, "open data commons", r"open data commons attribution {L}", "Open Data Commons Attribution License"),
    ("pddl-1.0", 3, "public domain dedication", r"public domain dedication (?:and|&) {L}", "Public Domain Dedication and License"),
    ("ogl-3.0", 3, "open government", r"open government {L}", "Open Government Licence"),
    ("cdla-permissive", 3, "community data", r"community data {L} agreement", "Community Data License Agreement"),
    ("ofl-1.1", 0, "spdx", r"spdx-license-identifier:~\(?ofl-1\.1", "SPDX-License-Identifier: OFL-1.1"),
    ("ofl-1.1", 3, "open font", r"(?:sil )?open font {L}", "SIL Open Font License"),
    # Source available
    ("bsl-1.1", 0, "spdx", r"spdx-license-identifier:~\(?busl-1\.1", "SPDX-License-Identifier: BUSL-1.1"),
    ("bsl-1.1", 3, "business source", r"business source {L}", "Business Source License"),
    ("sspl-1.0", 0, "spdx", r"spdx-license-identifier:~\(?sspl-1\.0", "SPDX-License-Identifier: SSPL-1.0"),
    ("sspl-1.0", 3, "server side public", r"server side public {L}", "Server Side Public License"),
    ("elastic-2.0", 0, "spdx", r"spdx-license-identifier:~\(?elastic-2\.0", "SPDX-License-Identifier: Elastic-2.0"),
    ("elastic-2.0", 2, "elastic", r"elastic {L}{V}{v2}", "Elastic License 2.0"),
    ("elastic", 3, "elastic", r"elastic {L}", "Elastic License"),
    ("commons-clause", 3, "commons clause", r"commons clause {L}", "Commons Clause License"),
    ("polyform", 3, "polyform", r"polyform [a-z]+(?: [a-z]+)? {L}", "PolyForm Noncommercial License"),
    ("rail", 3, "openrail|rail", r"(?:bigscience |creativeml )?open~rail(?:-[ms]|\+\+)?(?: {L})?", "CreativeML OpenRAIL-M license"),
    # Notices
    ("proprietary", 3, "proprietary", r"proprietary and confidential", "Proprietary and confidential"),
    ("proprietary", 3, "proprietary", r"confidential and proprietary", "confidential and proprietary"),
    ("proprietary", 3, "prohibited", r"unauthori[sz]ed (?:copying|use|distribution|reproduction)[^.]{0,120} prohibited", "Unauthorized copying of this file, via any medium is strictly prohibited"),
    ("proprietary", 3, "reproduced", r"no part of this (?:publication|book|document) may be reproduced", "No part of this publication may be reproduced"),
    ("warranty-disclaimer", 4, "without warranty", r"without warranty of any kind", "WITHOUT WARRANTY OF ANY KIND"),
    ("warranty-disclaimer", 4, "without any warranty", r"without any warranty", "but WITHOUT ANY WARRANTY"),
    ("warranty-disclaimer", 4, "as is", r"provided (?:by (?s:.){1,80} )?[\"']?as is[\"']?", "provided by the authors and contributors as is"),
    ("warranty-disclaimer", 4, "merchantability", r"implied warrant(?:y|ies) of merchantability", "the implied warranty of merchantability"),
    ("copyright", 4, "copyright", r"copyright~(?:\(c\)|\xc2\xa9|&copy;)?~(?:19|20)[0-9]{2}", "Copyright 2020 Foo"),
    ("copyright", 4, "(c)", r"\(c\)~(?:19|20)[0-9]{2}", "(c)2020"),
    ("copyright", 4, "&copy;|\xc2\xa9", r"(?:\xc2\xa9|&copy;)~(?:19|20)[0-9]{2}", "&copy; 2019"),
)
