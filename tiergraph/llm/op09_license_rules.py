"""Licence scans by sentence rules.

A text is cut into sentences; a sentence, normalised, that is a known licence sentence becomes its
identifier. A sentence may stand on one line or be wrapped over several, behind comment marks; blank
lines end it. n_sentences counts lines and the sentences in them, however they are wrapped. A rule is an ordered sequence of identifiers, and rules are tried in order on the
identifiers of a text, longest first. What a rule matched is not matched again.

DataFrame functions only. The SQL says the usual case, sentences on one line without comment marks. Defined results: a null or empty
text has no sentences and no licence; a null doc_id and repeated rows are kept as they come; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences known by an SPDX identifier line, and the names by which texts refer to them.
SPDX = [
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0",
    "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2",
    "GFDL-1.3", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "Python-2.0", "Ruby", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib",
]
NAMES: dict[str, str] = {
    "mit license": "MIT",
    "isc license": "ISC",
    "apache license, version 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "apache 2.0 license": "Apache-2.0",
    "bsd 2-clause license": "BSD-2-Clause",
    "bsd 3-clause license": "BSD-3-Clause",
    "boost software license, version 1.0": "BSL-1.0",
    "mozilla public license, version 2.0": "MPL-2.0",
    "mozilla public license 2.0": "MPL-2.0",
    "eclipse public license 2.0": "EPL-2.0",
    "gnu general public license, version 2": "GPL-2.0-only",
    "gnu general public license, version 3": "GPL-3.0-only",
    "gnu general public license v3.0": "GPL-3.0-only",
    "gnu lesser general public license, version 2.1": "LGPL-2.1-only",
    "gnu lesser general public license, version 3": "LGPL-3.0-only",
    "gnu affero general public license, version 3": "AGPL-3.0-only",
    "artistic license 2.0": "Artistic-2.0",
    "sil open font license, version 1.1": "OFL-1.1",
    "zlib license": "Zlib",
    "unlicense": "Unlicense",
    "creative commons attribution 4.0 international license": "CC-BY-4.0",
    "creative commons attribution-sharealike 4.0 international license": "CC-BY-SA-4.0",
    "creative commons attribution-noncommercial 4.0 international license": "CC-BY-NC-4.0",
}
#: Sentences that refer to a licence by its name.
FORMS = ["released under the {}", "licensed under the {}", "this project is licensed under the {}", "this work is licensed under the {}", "this work is licensed under a {}", "distributed under the {}", "this software is licensed under the {}", "this file is licensed under the {}"]

# Known licence sentences, normalised (lower case, single blanks, no final stop or colon).
TEXTS: dict[str, str] = {
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "MITwarranty",
    "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "MITliability",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so": "MIT0grant",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "0BSDgrant",
    "the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCwarranty",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDbinary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSDadvert",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDnames",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDnames",
    "licensed under the apache license, version 2": "APACHE2head",
    "licensed under the apache license, version 2.0 (the \"license\")": "APACHE2ref",
    "you may not use this file except in compliance with the license": "APACHEcomply",
    "you may obtain a copy of the license at": "APACHEobtain",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied": "APACHEwarranty",
    "see the license for the specific language governing permissions and limitations under the license": "APACHEsee",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "GPL3orLater",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "AGPL3orLater",
    "this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "LGPL3orLater",
    "this program is free software": "FreeProgram",
    "this library is free software": "FreeLibrary",
    "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLterms",
    "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPLterms",
    "either version 2 of the license, or (at your option) any later version": "Later2",
    "either version 2.1 of the license, or (at your option) any later version": "Later21",
    "either version 3 of the license, or (at your option) any later version": "Later3",
    "you should have received a copy of the gnu general public license along with this program": "GPLcopy",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPLcopy",
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPLcopy",
    "this source code form is subject to the terms of the mozilla public license, v": "MPL2form",
    "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/": "MPL2copy",
    "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/": "MPL2copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0": "EPL2terms",
    "this is free and unencumbered software released into the public domain": "UNLfree",
    "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "UNLanyone",
    "to the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0waive",
    "this software is provided 'as-is', without any express or implied warranty": "ZLIBasis",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "ZLIBgrant",
    "the origin of this software must not be misrepresented": "ZLIBorigin",
    "altered source versions must be plainly marked as such, and must not be misrepresented as being the original software": "ZLIBaltered",
    "this notice may not be removed or altered from any source distribution": "ZLIBnotice",
    "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following": "BOOSTgrant",
    "distributed under the boost software license, version 1.0": "BOOSTref",
    "permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "PGgrant",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed": "WTFPLcopy",
    "you just do what the fuck you want to": "WTFPLdo",
    "this font software is licensed under the sil open font license, version 1.1": "OFLref",
    "licensed under the eupl, version 1.2 or \u2013 as soon they will be approved by the european commission - subsequent versions of the eupl (the \"licence\")": "EUPLhead",
    "this work is licensed under the creative commons attribution 4.0 international license": "CCBY4ref",
    "licensed under cc by-nc 4.0": "CCBYNC4ref",
    "licensed under cc by 4.0": "CCBY4ref",
    "licensed under cc by-sa 4.0": "CCBYSA4ref",
    "licensed under cc by-nc-sa 4.0": "CCBYNCSA4ref",
    "licensed under cc by-nd 4.0": "CCBYND4ref",
    "released under cc0 1.0": "CC0ref",
    "all rights reserved": "AllRights",
}


def reference(name: str) -> str:
    """The identifier of a sentence that names a licence."""
    return "is " + name


def known_sentences() -> dict[str, str]:
    """TEXTS, and what FORMS and SPDX make: a sentence that TEXTS has keeps its identifier."""
    made = {f"spdx-license-identifier: {x.lower()}": reference(x) for x in SPDX}
    made |= {form.format(name): reference(x) for form in FORMS for name, x in NAMES.items()}
    return made | TEXTS


SENTENCES = known_sentences()

# Ordered rules over whole texts, tried from the first; an identifier sequence and the licence it states.
TEXT_RULES: list[tuple[tuple[str, ...], str]] = [
    (("BSDgrant", "BSDsource", "BSDbinary", "BSDadvert", "BSDnames"), "BSD-4-Clause"),
    (("BSDgrant", "BSDsource", "BSDbinary", "BSDnames"), "BSD-3-Clause"),
    (("BSDgrant", "BSDsource", "BSDbinary"), "BSD-2-Clause"),
    (("APACHE2ref", "APACHEcomply", "APACHEobtain", "APACHEwarranty", "APACHEsee"), "Apache-2.0"),
    (("APACHE2ref", "APACHEcomply", "APACHEobtain"), "Apache-2.0"),
    (("is Apache-2.0", "APACHEcomply", "APACHEobtain"), "Apache-2.0"),
    (("GPL3orLater", "GPLcopy"), "GPL-3.0-or-later"),
    (("AGPL3orLater", "AGPLcopy"), "AGPL-3.0-or-later"),
    (("LGPL3orLater", "LGPLcopy"), "LGPL-3.0-or-later"),
    (("FreeProgram", "GPLterms", "Later2", "GPLcopy"), "GPL-2.0-or-later"),
    (("FreeProgram", "GPLterms", "Later2"), "GPL-2.0-or-later"),
    (("FreeProgram", "GPLterms", "Later3"), "GPL-3.0-or-later"),
    (("FreeLibrary", "LGPLterms", "Later21", "LGPLcopy"), "LGPL-2.1-or-later"),
    (("FreeLibrary", "LGPLterms", "Later21"), "LGPL-2.1-or-later"),
    (("FreeLibrary", "LGPLterms", "Later3"), "LGPL-3.0-or-later"),
    (("MITgrant", "MITnotice", "MITwarranty", "MITliability"), "MIT"),
    (("MITgrant", "MITnotice"), "MIT"),
    (("MIT0grant", "MITwarranty"), "MIT-0"),
    (("ISCgrant", "ISCwarranty"), "ISC"),
    (("0BSDgrant", "ISCwarranty"), "0BSD"),
    (("ZLIBasis", "ZLIBgrant", "ZLIBorigin", "ZLIBaltered", "ZLIBnotice"), "Zlib"),
    (("UNLfree", "UNLanyone"), "Unlicense"),
    (("MPL2form", "MPL2copy"), "MPL-2.0"),
    (("WTFPLcopy", "WTFPLdo"), "WTFPL"),
    (("BOOSTgrant",), "BSL-1.0"),
    (("BOOSTref",), "BSL-1.0"),
    (("PGgrant",), "PostgreSQL"),
    (("EPL2terms",), "EPL-2.0"),
    (("OFLref",), "OFL-1.1"),
    (("EUPLhead",), "EUPL-1.2"),
    (("MPL2form",), "MPL-2.0"),
    (("UNLfree",), "Unlicense"),
    (("CC0waive",), "CC0-1.0"),
    (("ISCgrant",), "ISC"),
    (("0BSDgrant",), "0BSD"),
    (("GPL3orLater",), "GPL-3.0-or-later"),
    (("AGPL3orLater",), "AGPL-3.0-or-later"),
    (("LGPL3orLater",), "LGPL-3.0-or-later"),
    (("APACHE2ref",), "Apache-2.0"),
    (("CCBYNCSA4ref",), "CC-BY-NC-SA-4.0"),
    (("CCBYNC4ref",), "CC-BY-NC-4.0"),
    (("CCBYSA4ref",), "CC-BY-SA-4.0"),
    (("CCBYND4ref",), "CC-BY-ND-4.0"),
    (("CCBY4ref",), "CC-BY-4.0"),
    (("CC0ref",), "CC0-1.0"),
    (("APACHE2head", "APACHEcomply", "APACHEobtain"), "Apache-2.0"),
    (("APACHE2head",), "Apache-2.0"),
    (("AllRights",), "Proprietary"),
]
#: TEXT_RULES, and a reference states the licence that it names (GPL-3.0 and its like are the -only form).
RULES = TEXT_RULES + [((reference(x),), f"{x}-only" if x in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") else x) for x in SPDX]

#: A sentence ends at a newline, or at a stop, exclamation or question mark or semicolon before white space or the end.
BREAK = r"\n|[.!?;]+(?:[ \t\r]+|$|\n)"
BLANKS = r"[ \t\r\x0b\f]+"
#: Comment and quotation marks at a line's start and end; runs are taken whole, so that long ones cost no more than their length.
LEADER = r"""(?md)^[ #*/;%>!|"'\u2022-]*+(?:(?:dnl|rem) +)?"""
TRAILER = r"""(?md)(?<![ #*/>|"'-])[ #*/>|"'-]++$"""
#: Ends a sentence on the way of wrapped(); no text has it.
END = "\x02"


def rule_pattern(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def sentences(text: Column) -> Column:
    """Normalised sentences of a whole text: lower case, single blanks, no colon at the end."""
    low = F.regexp_replace(F.lower(text), BLANKS, " ")
    return F.transform(F.split(low, BREAK), lambda s: F.trim(F.rtrim(F.trim(s), F.lit(":"))))


def wrapped(text: Column) -> Column:
    """A whole text in lower case without comment marks: END between sentences, newlines only where a line may go on."""
    low = F.regexp_replace(F.translate(F.lower(text), END, " "), BLANKS, " ")
    lines = F.regexp_replace(F.regexp_replace(low, LEADER, ""), TRAILER, "")
    return F.regexp_replace(F.regexp_replace(lines, r"[.!?;]+(?: +|$|\n)", END), r"\n{2,}", END)


def sentence_ids(text: Column, known: dict[str, str] | None = None) -> Column:
    """Identifiers of a text's known sentences, in order; where one begins with another, the longer counts."""
    known = known or SENTENCES
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    one = "|".join(re.sub(r"\\? ", "[ \\\\n]", re.escape(s)) for s in sorted(known, key=len, reverse=True))
    # known sentences begin and end where sentences or lines do
    pattern = rf"(?:\A|(?<=[\n{END}])) *({one}) *:* *(?=[\n{END}]|\z)"
    return F.transform(F.regexp_extract_all(wrapped(text), F.lit(pattern), 1), lambda s: lookup[F.translate(s, "\n", " ")])


def scan(docs: DataFrame, rules: list[tuple[tuple[str, ...], str]] | None = None, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_sentences, n_known, sequence (identifiers in order), licenses (found, comma-joined, sorted), unmatched.

    unmatched counts known sentences that no rule took.
    """
    rules = rules or RULES
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.filter(sentences(text), lambda s: s != "")).cast("long").alias("n_sentences"), sentence_ids(text, known).alias("ids"))
    rest = F.concat(F.lit(""), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    out = found.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), rest.alias("sequence"))

    def step(state: Column, rule: Column) -> Column:
        """The rest without what a rule matches, and the licences so far."""
        left = F.replace(state["rest"], rule["pattern"], F.lit("/"))
        return F.struct(left.alias("rest"), F.when(left == state["rest"], state["names"]).otherwise(F.array_append(state["names"], rule["name"])).alias("names"))

    # few texts hold a known sentence, so few go through the rules
    listed = F.array(*[F.struct(F.lit(rule_pattern(ids)).alias("pattern"), F.lit(name).alias("name")) for ids, name in rules])
    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("names"))
    out = out.withColumn("end", F.when(F.col("sequence") == "", start).otherwise(F.aggregate(listed, start, step)))
    last = F.col("end.rest")
    names = F.array_sort(F.array_distinct(F.col("end.names")))
    left = F.char_length(last) - F.char_length(F.replace(last, F.lit("<"), F.lit("")))
    return out.select("doc_id", "n_sentences", "n_known", "sequence", F.array_join(names, ",").alias("licenses"), left.cast("long").alias("unmatched"))
