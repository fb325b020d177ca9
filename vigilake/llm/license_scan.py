"""License scans by canonical digest lookup.

A text is reduced to a canonical form (case, copyright lines, spellings, punctuation), and the SHA-256 of
the whole form is hash-joined to a table of known licence digests. The same lookup runs on every line, which
finds one-line notices. Only DataFrame functions are used.

Null text counts as empty; an empty canonical form matches nothing. Repeated rows each get their own result
row; a null id stays null. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: British and variant spellings to one form, in order; applied to lower-case words without punctuation.
SPELLINGS = [
    ("licence", "license"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
    ("honour", "honor"), ("modelled", "modeled"), ("whilst", "while"), ("per cent", "percent"), ("noninfringement", "non infringement"),
    ("copyright holder", "copyright owner"), ("merchantibility", "merchantability"), ("initialise", "initialize"), ("https ", "http "),
]
#: Lines that state a copyright: a mark with a year or a template's blank, or two marks in a row. Clauses such as "(c) You must" and
#: wrapped lines such as "copyright notice, this list" are text.
COPYRIGHT_LINE = (
    r"(^|\n)[^a-z0-9\n(©<]*(copyright[^a-z0-9\n]*(\(c\)|©)|©|copyright[^\n]{0,40}((19|20)[0-9][0-9]|[<\[{](yyyy|year))"
    r"|\(c\)[^\n]{0,20}(19|20)[0-9][0-9]|all rights reserved[^a-z0-9\n]*(\n|$))[^\n]*"
)
PUNCTUATION = r"[\x00-/:-@\[-`{-\x7f]+"
LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: SHA-256 of canonical forms. Whole licences first, then one-line notices.
KNOWN: dict[str, str] = {
    "353e0febe7ff848767b8b4c5043be017cf437ea3493e750dd118874f1352ec5b": "MIT",
    "96e050516cc7aa95addc45780600b33ca4b6f5d0d89a1837f35096fc4a3d49c3": "MIT",
    "d9d122924de0a3072ce1453a3cccd65a467f103a263ff4501b13a6db397f038a": "MIT",
    "1c31d6720671c08f35b8299b2960996e695ece9ef0011715598a3e9b0013f3de": "MIT-0",
    "0dd71b7d5a9c5ddca069f0bb9fee1f52cb0a81614ccb432903dc304a086246be": "MIT-0",
    "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a": "ISC",
    "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee": "ISC",
    "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c": "0BSD",
    "925e3306eb4a5616de812ebe7636c82195825e66ae2e33f8b7f4a9697c78b03b": "BSD-2-Clause",
    "326e1c212e3d6ca64decd72383dd96a7f1b1a92af152332406bacff406b88990": "BSD-2-Clause",
    "ab899150d08a3ccf837f742a20fbd8dd108031100312f3224aa5e2d14e0d60f1": "BSD-3-Clause",
    "18b8c3806553726bfe7a3ec868ea4d82d82dbaed215618da6e21ce04a3e9c1d6": "BSD-3-Clause",
    "9ceffc7334827b41e43b88145636107fd3a7ff101b195d3ff37c84c1df553594": "Unlicense",
    "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7": "Zlib",
    "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a": "Zlib",
    "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2": "Apache-2.0",
    "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0": "Apache-2.0",
    "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f": "GPL-1.0",
    "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6": "GPL-2.0",
    "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8": "GPL-3.0",
    "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e": "LGPL-2.0",
    "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd": "GFDL-1.2",
    "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd": "GFDL-1.3",
    "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93": "Artistic-1.0-Perl",
    "123a3b9fdc300d1b6f077f74b288de15d7f2c5b0b3b11e89fd799b48bfad5940": "MIT",
    "00217f00b903e5911b513ea1f36a2aeb7b8999ee6622cd67b2e675f98285e541": "MIT",
    "6574b7ebe0cb585e9b2f2c05d1e04a3181922d9bf36edf6c9f6a3cba7bac1564": "MIT",
    "37d45dc3b9135ed58bd277e14112dfea95629cda77a8d62cdb6bcd862e7b5bf5": "GPL-3.0",
    "86cc14fde51d648e1d084ecc39341eefd11fedf263aba490c5b70924ca271986": "GPL-3.0",
    "e34399ae0e957e9bb9b4a0e3f615d05722861801f4e0718f35cefc762c349a16": "CC-BY-NC-4.0",
    "eff9e05c9de2ebaf67a47336fef7135676ea38a388048f3f843195d9ee4d2e77": "Apache-2.0",
    "4af76f6b1905a1186b51e0941ebeff988b0a3e53ec61a8b9d91a93a67097e825": "BSD-3-Clause",
    "5aee400278b51606c2353a854f7d936ffffe555bf9c67e56d5db376a76b63bb2": "CC-BY-4.0",
    "96915353d7a84082bcbf6b803c99c651e279a832da34fbea4ba84c9005155395": "CC0-1.0",
}


def canonical(text: Column) -> Column:
    x = F.translate(F.coalesce(text, F.lit("")), LOWER_FROM, LOWER_TO)
    x = F.regexp_replace(x, COPYRIGHT_LINE, "\n")
    x = F.trim(F.regexp_replace(x, PUNCTUATION, " "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def canonical_py(text: str) -> str:
    """The same form outside Spark, to make entries of the digest table."""
    x = (text or "").translate(str.maketrans(LOWER_FROM, LOWER_TO))
    x = re.sub(COPYRIGHT_LINE, "\n", x)
    x = re.sub(PUNCTUATION, " ", x).strip(" ")
    for a, b in SPELLINGS:
        x = x.replace(a, b)
    return x


def digest_py(text: str) -> str:
    return hashlib.sha256(canonical_py(text).encode()).hexdigest()


def known_digests(spark: SparkSession, extra: dict[str, str] | None = None) -> DataFrame:
    """digest, license: a table of fixed size (the dictionary above and what the caller adds)."""
    return spark.createDataFrame(sorted({**KNOWN, **(extra or {})}.items()), "digest string, license string")


def scan(docs: DataFrame, extra: dict[str, str] | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest, license (null: the whole text is no known licence), notices (sorted ids found on its lines)."""
    known = known_digests(docs.sparkSession, extra)
    pairs = [F.lit(x) for kv in sorted({**KNOWN, **(extra or {})}.items()) for x in kv]
    table = F.create_map(*pairs)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))
    lines = F.split(F.translate(F.coalesce("body", F.lit("")), "\r", "\n"), "\n")
    hits = F.transform(lines, lambda x: F.element_at(table, F.sha2(canonical(x), 256)))
    shaped = rows.select("id", F.sha2(canonical(F.col("body")), 256).alias("digest"), F.array_compact(hits).alias("hits"))
    return shaped.join(F.broadcast(known), "digest", "left").select(
        F.col("id").alias(key), "digest", "license", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices")
    )


def oracle() -> str:
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(KNOWN.items()))
    return f"""
WITH known(digest, license) AS (VALUES {values}),
lines AS (SELECT DISTINCT doc_id, sha256({_form_sql('line')}) AS digest FROM (
    SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10))) AS line FROM documents)),
found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_form_sql('text')}) AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license, coalesce(f.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN found f ON w.doc_id = f.doc_id"""


def _form_sql(column: str) -> str:
    x = f"translate(coalesce({column}, ''), '{LOWER_FROM}', '{LOWER_TO}')"
    x = f"regexp_replace({x}, '{COPYRIGHT_LINE}', chr(10), 'g')"
    x = f"trim(regexp_replace({x}, '{PUNCTUATION}', ' ', 'g'), ' ')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return x
