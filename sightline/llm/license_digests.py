"""Licence scan by canonical digests: whole texts, and whole lines, against known licence texts.

The canonical form is a sequence of words, so it does not depend on line breaks,
indentation or comment marks. A title and copyright notices count as such in front of the
words that a known licence begins with; holders' names inside the BSD licences and addresses
in the GNU ones are made equal; equivalent spellings too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.known_licenses import DIGESTS

#: Spellings that licence comparison treats as equal, each with its canonical form.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorise": "authorize", "authorised": "authorized",
    "authorisation": "authorization", "behaviour": "behavior", "catalogue": "catalog", "centre": "center",
    "customisation": "customization", "emphasise": "emphasize", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelling": "modeling",
    "organisation": "organization", "optimise": "optimize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "rightsholder": "rightholder", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "http": "https",
    "non  infringement": "noninfringement", "sub  license": "sublicense", "copyright  owner": "copyright  holder", "per  cent": "percent",
}

#: Texts of short licences and the usual notices of longer ones; DIGESTS has more whole texts.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction
and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity
of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC0-1.0-notice": "Released under CC0 1.0.",
}

#: What stands above licence texts, as words, and the words that the texts begin with.
TITLES = (
    "mit license", "the mit license", "mit license mit", "the mit license mit", "expat license", "isc license", "the isc license", "isc license isc",
    "bsd license", "the bsd license", "new bsd license", "modified bsd license", "simplified bsd license", "bsd 2 clause license", "the bsd 2 clause license",
    "bsd 2 clause simplified license", "bsd 3 clause license", "the bsd 3 clause license", "bsd 3 clause new or revised license",
    "zero clause bsd", "bsd zero clause license", "bsd zero clause license 0bsd", "boost software license version 1 0 august 17th 2003",
    "zlib license", "the zlib license", "zlib libpng license", "unlicense", "the unlicense",
    "apache license version 2 0 january 2004 https www apache org licenses", "apache license version 2 0 january 2004", "apache license",
    "mozilla public license version 1 1", "mozilla public license version 2 0", "creative commons legal code cc0 1 0 universal", "the artistic license",
    "gnu general public license version 1 february 1989", "gnu general public license version 2 june 1991", "gnu general public license version 3 29 june 2007",
    "gnu library general public license version 2 june 1991", "gnu lesser general public license version 2 1 february 1999",
    "gnu lesser general public license version 3 29 june 2007", "gnu free documentation license version 1 2 november 2002",
    "gnu free documentation license version 1 3 3 november 2008",
)
OPENINGS = (
    "permission is hereby granted free of charge to any person", "permission to use copy modify and or distribute this software",
    "redistribution and use in source and binary forms", "this software is provided as is without any express or implied warranty",
    "this is free and unencumbered software released into the public domain", "terms and conditions for use reproduction and distribution",
    "1 definitions 1 1 contributor means", "1 definitions 1 0 1 commercial use means", "creative commons corporation is not a law firm",
    "everyone is permitted to copy and distribute verbatim copies of this license document",
    "preamble the intent of this document is to state the conditions under which a package may be copied",
)
#: Fixed values: (words that must occur, pattern, replacement) for what differs between copies of one licence. Patterns are for words with two spaces between them.
WORDINGS = (
    ("redistribution and use in source and binary forms", r"  (?:1|2|3|a|b|c|i|ii|iii)  (redistributions  of|redistributions  in|neither  the  name)", r"  \1"),
    ("redistribution and use in source and binary forms", r"  neither  the  names?  of  .{1,200}?  nor  the  names  of  (?:its  |their  |other  |any  )?contributors  ",
     "  neither  the  name  of  the  copyright  holder  nor  the  names  of  its  contributors  "),
    ("redistribution and use in source and binary forms", r"  software  is  provided  by  .{1,200}?  as  is  and  ", "  software  is  provided  by  the  copyright  holders  and  contributors  as  is  and  "),
    ("redistribution and use in source and binary forms", r"  in  no  event  shall  .{1,200}?  be  liable  ", "  in  no  event  shall  the  copyright  holder  or  contributors  be  liable  "),
    ("licensed under the apache license version 2 0", r"  copyright  .{1,200}?  licensed  under  the  apache  license  ", "  licensed  under  the  apache  license  "),
    ("free software foundation inc", r"  free  software  foundation  inc  (?:51  franklin  (?:street|st)  fifth  floor  boston  ma  02110  1301|59  temple  place  (?:suite  330  )?boston  ma  02111  1307|675  mass  ave  cambridge  ma  02139)(?:  usa)?  ",
     "  free  software  foundation  inc  "),
)

_PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x{A8}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{2000}-\x{206F}]+"


#: Any variant, by its first letter.
_VARIANTS = " (?:%s) " % "|".join(
    f"{first}(?:{'|'.join(v[1:] for v in SPELLINGS if v[0] == first)})" for first in sorted({v[0] for v in SPELLINGS})
)


def _spread(words: str) -> str:
    return words.replace(" ", "  ")


#: Title, notices, and then a licence's own words.
_HEADED = (
    f"^ (?:(?:{'|'.join(_spread(t) for t in sorted(TITLES, key=len, reverse=True))})  )?"
    f"(?:(?:c  )?copyright  .{{0,800}}?  )?((?:{'|'.join(map(_spread, OPENINGS))}) .*)$"
)


def plain(text: Column) -> Column:
    """The words in lower case without punctuation; null counts as empty.

    Each word has a space of its own on either side, so that neighbouring spellings
    are replaced independently.
    """
    signed = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("©"), F.lit("(c)"))
    return F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(signed, _PUNCTUATION, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))


def spelled(text: Column) -> Column:
    """Equivalent spellings made equal, one after the other; texts without any variant are seen by one search.

    A fold, as that many nested calls grow beyond what Spark compiles.
    """
    pairs = F.array(*[F.struct(F.lit(f" {v} ").alias("variant"), F.lit(f" {u} ").alias("usual")) for v, u in SPELLINGS.items()])

    def folded(t: Column) -> Column:
        return F.when(t.rlike(_VARIANTS), F.aggregate(pairs, t, lambda x, p: F.replace(x, p["variant"], p["usual"]))).otherwise(t)

    return F.get(F.transform(F.array(text), folded), F.lit(0))


def own_words(text: Column) -> Column:
    """The words of ``text``, spelled, without title and notices, and with the wordings that differ between copies made equal."""

    def with_usual(marker: str, pattern: str, usual: str):
        usual = usual.replace("\\1", "$1")
        return lambda w: F.when(F.contains(w, F.lit(f" {_spread(marker)} ")), F.regexp_replace(w, pattern, usual)).otherwise(w)

    words = F.regexp_replace(spelled(plain(text)), _HEADED, " $1")
    for wording in WORDINGS:  # each step's text is a lambda's variable: a plain expression would be written out three times a step
        words = F.get(F.transform(F.array(words), with_usual(*wording)), F.lit(0))
    return words


def build(spark: SparkSession, texts: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """Digests of whole texts by id, as DIGESTS lists them: each as it is, and up to the end of its terms with and without the line that says so, as many copies leave out what follows."""
    rows = spark.createDataFrame(sorted(texts.items()), "license_id string, body string")
    words = rows.select("license_id", own_words(F.col("body")).alias("words"))
    end = f" {_spread('end of terms and conditions')} "
    body = F.substring_index("words", end, 1)
    ended = F.contains("words", F.lit(end))
    forms = F.array("words", F.when(ended, F.concat(body, F.lit(end))).otherwise(F.col("words")), F.when(ended, F.concat(body, F.lit(" "))).otherwise(F.col("words")))
    found: dict[str, set] = {}
    for r in words.select("license_id", F.explode(F.transform(forms, lambda x: F.sha2(x, 256))).alias("digest")).collect():
        found.setdefault(r["license_id"], set()).add(r["digest"])
    return {k: tuple(sorted(v)) for k, v in sorted(found.items())}


def longest(known: list[str]) -> int:
    """No text with more plain characters can equal a known one: a spelling is at most two characters longer than its canonical form."""
    return max((2 * len(k) + 2 * len(k.split()) + 2 for k in known), default=0)


def _telling(notice: str) -> str:
    """The longest word of a notice that has one spelling only; a line without it cannot be that notice."""
    spellings = {w for pair in SPELLINGS.items() for x in pair for w in x.split()}
    return max((w for w in re.findall("[a-z0-9]+", notice.lower()) if w not in spellings), key=len, default="")


def scan(docs: DataFrame, text: str = "text", out: str = "license", known: dict[str, str] = KNOWN, digests=DIGESTS) -> DataFrame:
    """Append struct ``out``: digest of the whole text, id of the licence it is, and ids of notices that are whole lines.

    The known texts and the digests of further ones are arguments and few literal
    rows, so their side of the join is broadcast. Every
    input row gives one row; null and empty texts match no licence and have no
    notices; a column already named ``out`` is replaced. Notices are sorted by id
    and listed once; of known texts with equal digests the smaller id counts.
    """
    table = docs.sparkSession.createDataFrame(sorted(known.items()), "license_id string, body string")
    digested = table.select("license_id", F.sha2(own_words(F.col("body")), 256).alias("known_digest"))
    stored = [(k, d) for k, listed in sorted(digests.items()) for d in listed]
    digested = digested.unionByName(docs.sparkSession.createDataFrame(stored, "license_id string, known_digest string"))
    table = digested.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))
    notices = {k: v for k, v in sorted(known.items()) if "\n" not in v}
    column = F.col(f"`{text}`")
    lines = F.filter(F.split(F.coalesce(column, F.lit("")), "\n"), lambda x: x.rlike(f"(?i){'|'.join(_telling(n) for n in notices.values())}"))
    lines = F.transform(lines, plain)
    lines = F.transform(F.filter(lines, lambda x: F.length(x) <= longest(list(notices.values()))), spelled)
    wanted = F.array(*[spelled(plain(F.lit(v))) for v in notices.values()]).cast("array<string>")
    ids = F.array(*[F.lit(k) for k in notices]).cast("array<string>")
    hits = F.array_sort(F.transform(F.array_intersect(lines, wanted), lambda x: F.get(ids, (F.array_position(wanted, x) - 1).cast("int"))))
    columns = [c for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.sha2(own_words(column), 256).alias("known_digest"), hits.alias("notices"))
    found = rows.join(F.broadcast(table), "known_digest", "left")
    return found.select("row.*", F.struct(F.col("known_digest").alias("digest"), "license_id", "notices").alias(out))


def oracle_sql(known: dict[str, str] = KNOWN, digests=DIGESTS) -> str:
    """The scan of ``documents`` for DuckDB."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def plain_sql(x: str) -> str:
        x = f"replace(lower(coalesce({x}, '')), '©', '(c)')"
        return f"(' ' || replace(trim(regexp_replace({x}, {quoted(_PUNCTUATION)}, ' ', 'g')), ' ', '  ') || ' ')"

    def spelled_sql(x: str) -> str:
        for variant, usual in SPELLINGS.items():
            x = f"replace({x}, ' {variant} ', ' {usual} ')"
        return x

    def steps(source: str, key: str, x: str) -> str:
        """Subqueries that lead from texts to digests, a step each."""
        out = f"SELECT {key}, {spelled_sql(plain_sql(x))} AS w FROM {source}"
        out = f"SELECT {key}, regexp_replace(w, {quoted(_HEADED)}, ' \\1') AS w FROM ({out})"
        for marker, pattern, usual in WORDINGS:
            out = f"SELECT {key}, CASE WHEN contains(w, {quoted(f' {_spread(marker)} ')}) THEN regexp_replace(w, {quoted(pattern)}, {quoted(usual)}, 'g') ELSE w END AS w FROM ({out})"
        return f"SELECT {key}, sha256(w) AS digest FROM ({out})"

    notices = {k: v for k, v in sorted(known.items()) if "\n" not in v}
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(known.items()))
    stored = ", ".join(f"({quoted(k)}, {quoted(d)})" for k, listed in sorted(digests.items()) for d in listed)
    short = ", ".join(quoted(k) for k in notices)
    return f"""
WITH texts AS (SELECT * FROM (VALUES {rows}) v(license_id, body)),
known AS (SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, digest FROM ({steps('texts', 'license_id', 'body')}) UNION ALL SELECT * FROM (VALUES {stored}) s(license_id, digest)) GROUP BY 1),
notices AS (SELECT license_id AS notice_id, {spelled_sql(plain_sql('body'))} AS line FROM texts WHERE license_id IN ({short})),
digests AS ({steps('documents', 'doc_id', 'text')}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
short_lines AS (SELECT doc_id, {spelled_sql('p')} AS line FROM (SELECT doc_id, {plain_sql('raw')} AS p FROM lines)
    WHERE length(p) <= {longest(list(notices.values()))}),
hits AS (SELECT doc_id, string_agg(DISTINCT notice_id, ',' ORDER BY notice_id) AS notices
    FROM short_lines JOIN notices USING (line) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license_id, coalesce(h.notices, '') AS notices
FROM digests d LEFT JOIN known k ON d.digest = k.digest LEFT JOIN hits h ON d.doc_id = h.doc_id"""
