"""Licence scans: a canonical digest of each whole text, joined to those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL2_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
# Licence texts and standard notices, by their public short names.
KNOWN = {
    "MIT": _MIT,
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}",
    "0BSD": f"{_ISC_GRANT}.\n\n{_ISC_END}",
    "BSD-2-Clause": f"{_BSD_HEAD}\n\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD_HEAD}\n\n{_BSD_THIRD}\n\n{_BSD_END}",
    "Zlib": _ZLIB,
    "Apache-2.0 (notice)": _APACHE_NOTICE,
    "GPL-3.0-or-later (notice)": _GPL3_NOTICE,
    "AGPL-3.0-or-later (notice)": _GPL3_NOTICE.replace("GNU General", "GNU Affero General"),
    "LGPL-3.0-or-later (notice)": _GPL3_NOTICE.replace("GNU General", "GNU Lesser General"),
    "MPL-2.0 (notice)": _MPL2_NOTICE,
    "Unlicense": _UNLICENSE,
    "BSL-1.0": _BOOST,
}
# Spellings that count as the same, after case and punctuation are gone.
SAME = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("organisation", "organization"), ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("honour", "honor"), ("judgement", "judgment"), ("merchantibility", "merchantability"), ("noninfringment", "noninfringement"), ("per cent", "percent"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http"), ("non commercial", "noncommercial"),
)
#: Lines that only say whose copyright it is: with a sign, a year or a place for one, or a name.
COPYRIGHT = r"(?:^|\n)[ \t#*/;-]*(?:[Pp]ortions[ \t]+)?(?:(?i:copyright|\(c\)|\xA9)(?:[ \t:,]+(?:\([Cc]\)|\xA9|[0-9<\[{])[^\n]*|[ \t]*(?:\([Cc]\)|\xA9)[^\n]*)|[Cc]opyright[ \t:,]+[A-Z][^\n]*)"
#: A first line that is only a licence's name, and what items of a list begin with.
TITLE = r"(?i)^[\s#*/;-]*(?:the[ \t]+)?(?:mit|isc|zlib|unlicense|bsd[ \t]+[0-9]-clause|[0-9]-clause[ \t]+bsd|(?:new|simplified|modified|revised)[ \t]+bsd|bsd)(?:[ \t]+licen[sc]e)?[ \t]*(?:\([a-z0-9 -]+\))?[ \t]*\r?\n"
ITEM = r"(?m)^[ \t#*/;]*(?:\(?[0-9a-z]{1,2}[.)]|[*-])[ \t]+"
_RIGHTS = r"(?i)(?:^|\n)[ \t#*/;-]*all rights reserved[ \t.]*(?:$|\n)"


_STEPS = ((TITLE, "\n"), (COPYRIGHT, "\n"), (COPYRIGHT, "\n"), (_RIGHTS, "\n"), (_RIGHTS, "\n"), (ITEM, ""))


def canonical(text: Column) -> Column:
    """Lower case words with one space between: no title, copyright lines, marks of comments, lists or punctuation, and one spelling of each word."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    # Twice: a match takes the line end that the next line would begin with.
    for pattern, by in _STEPS:
        t = F.regexp_replace(t, pattern, by)
    t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Two blanks between words: neighbours do not share one, and each is replaced.
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{AB}\x{BB}\x{2010}-\x{2027}]+", "  "), F.lit(" "))
    for old, new in SAME:
        t = F.replace(t, F.lit(f" {old} ".replace(" ", "  ")[1:-1]), F.lit(f" {new} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """digest and license: one row for each known text."""
    rows = list((KNOWN if known is None else known).items())
    table = docs.sparkSession.createDataFrame(rows, "license string, text string")
    return table.select(digest(F.col("text")).alias("digest"), F.regexp_replace("license", r" \(no title\)$", "").alias("license")).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest and license (null where the whole text is no known one) of every row of docs.

    Null and empty texts have the digest of the empty text, and no licence, as have
    texts of copyright lines alone. Repeated rows and null ids stay as they are.
    """
    table = known_digests(docs, known).where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    # A row for each known licence: a size fixed by the table.
    return rows.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license")


def sql(known: dict[str, str] | None = None, docs: str = "documents") -> str:
    """The same over `docs` as one statement of plain SQL (DuckDB's functions)."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    import re

    def expression(t: str) -> str:
        t = f"regexp_replace(coalesce({t}, ''), '\\r\\n?', chr(10), 'g')"
        for pattern, by in _STEPS:
            t = f"regexp_replace({t}, {quote(pattern.replace(chr(92) + 'xA9', chr(92) + 'x{A9}'))}, {'chr(10)' if by else quote('')}, 'g')"
        t = f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        t = f"' ' || regexp_replace({t}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F\\x{{A0}}\\x{{AB}}\\x{{BB}}\\x{{2010}}-\\x{{2027}}]+', '  ', 'g') || ' '"
        for old, new in SAME:
            t = f"replace({t}, {quote(f' {old} '.replace(' ', '  ')[1:-1])}, {quote(f' {new} ')})"
        return f"sha256(trim(replace({t}, '  ', ' '), ' '))"

    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in (KNOWN if known is None else known).items())
    return re.sub(
        r"\s+\n", "\n",
        f"""WITH known AS (SELECT {expression('text')} AS digest, min(regexp_replace(license, ' \\(no title\\)$', '')) AS license FROM (VALUES {rows}) k(license, text) GROUP BY 1)
SELECT d.doc_id, d.digest, k.license FROM (SELECT doc_id, {expression('text')} AS digest FROM {docs}) d
LEFT JOIN known k ON d.digest = k.digest AND d.digest <> sha256('')""",
    )
