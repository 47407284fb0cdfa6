"""License scans by canonical digest: entire texts, normalised and hashed, are joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: SPDX name and an entire text or notice under it.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    *(("ISC", f"{title}{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}") for title in ("ISC License\n\n", "The ISC License\n\n", "ISC License (ISC)\n\n")),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    *(("0BSD", f"{title}{_ISC_GRANT}.\n\n{_ISC_END}") for title in ("BSD Zero Clause License\n\n", "Zero-Clause BSD\n\n", "Zero-Clause BSD License\n\n")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: SPDX name and the digests of an entire normalised text, for licences too long to be here in full. Each is with and
#: without its title lines, and where there are such parts with and without what follows the end of terms (Apache, GPL, LGPL 2 and
#: 2.1), the exhibits (MPL) or the notes before it (CC0, CC BY-SA); addresses are http or https. BSD is numbered or not, has "holder"
#: or "owner" in the disclaimer, and "All rights reserved." or not. Made by digest() from the texts in /usr/share/common-licenses
#: and in packages' copyright files; they hold as long as normalised() stays.
DIGESTS = {
    "Apache-2.0": """
        147b208dd396ecb8fa5ed0fc687ad08e 46a8935e8de765d0490a0d72cbc35b54 78d85f55a8cc5eb34c34fd706a7f021c 7bef88638fbb2a32d6db67ff36640c7f
        7da88a307eb085ac5c11cf87c946a6f4 7fc4eaaab3c37b95adc36eecd3bc24f8 cc6e17dea971d2c607938173926934fe cdf4e107e312f95f9187418614789d6f
        e644914e4f37f6d3249a12555f78d0fa f21a6a00d0292e07f74a8b313181e5a3
    """,
    "BSD-2-Clause": """
        015f259e1226c5f23f50acfb90bfaadb 020b4d8cb51200259d06e94412558807 0816bdc51b179499d74dfcc78757f17e 1e7239d5d588e3cba869b064ace4e0ce
        23f60ca28f74c5b051d3c7ed63325ef9 2c7989b85f748882f0e86f419d5b6d4c 2e3679d87f879fc22e5d502ce825d217 30aa83b5655a2a5070ac382ef450ab15
        3735ec5f914e271b9509879dabcc8440 37e54b747ce0a8ebcdd547818a7cdc22 3fcacb9df7fa2fbf8f063a54bc36b0bf 455237da4770c376c2b76b36ecb083dd
        55d7089848c079c410d56b7f9e952216 562e5a4d57b3796581dcbe49e937dc76 5e70afed8a5b2a2ad6b5918038e0721c 62ffbf998ca9af016145383938cf2296
        636b7523b7b31c96908f2a043c9258d2 67ac51a6aa38b353356fd0452d986401 6a8217eb1d1120e8522c8f887af528a7 905038a315bd4ce61865f23bcd766e08
        92ebd1daa8d92eee1d2ec5b75d837d05 99ccf4df4f1e93f3225abc1575ff7ccf 9a922228e51b12feab2aa838fbaf3bd2 afae269787d54b0e934d7d644e18fd2c
        bee76ab8d704f885cef75d4ebaafd74d d247a5d6a3519cd7b52c64cde6470d26 d5998854c59e5b2f64ae1d12998163dc db30a951ebd310d3106bdeabdec4ce3b
        dc2239cdffdec83ba4f2f2fcbc9a309a df3de03c83efb49191d268382a627d8f e1cf552450dab3782115fd8ef5749831 e57d39b8476f818ba12e0ba902781d28
    """,
    "BSD-3-Clause": """
        0343d008608c00b12229fa526b5024ad 0df10a4a64a9d5b2f8b21e02ba10724c 171872bf67acb6d1f58438315f7eab84 18023134ce14eb0a64f4949c7ac85848
        1d8c154e915ede9d21043f48a50a9861 31d8807897d810711f2a906ca543cd9c 33a29d62df1e7f7d0c842bbbd32ccedf 3ef613fb5c53f01392a3824d22ae9adb
        477a225be965518763aeb3ebfa9855bb 482f4fa1dfb03020242015a864c43bf4 49a4719d06a5c099f3fa78395ba7e230 5bed1e94f054513baabe19a53872eb8d
        5d8cc08b8f9ace93a06e5abdd1034565 5fa507557e8cd937e8e0290231a5f35e 613101441cef009d745cddd45cba8f27 6140e29c2791eb67cb2f98eafc5c3c9e
        63c7265b33e71baf1db85f99a12c83c4 6cf4720afbffbdc9f0d3176588e799e2 6d1d16ea5a3cc6bde6cee1f7a401e935 714b9de4a8a88722813094fb9cd554f0
        7edc5f78013dd0b1841e049c2c45b9b2 86e6994692fdf7fa78934fdb76c9e131 8a9c26aa625c04724a3720eba09dc7aa 9c16d0dce560589d8c2e4e17e57937ab
        a24e9339e38b99c2cf3341d0d1a1a463 a580560ba64c3d95b5dc7e2d197ac36d af57b89b640df23c2b84905b8667f7a1 e40ee400455ca9184f1a482581efbf17
        e49b214a5276044dab91c260aee69f19 eeec0e88a33ba27e7f5c5fbe659d5c2b f829b98ddfded9c083ebf8e91eff7032 fff0572a5c0c4814611bb6cad2c7cd90
    """,
    "CC-BY-SA-4.0": """
        9790bbbbd107577a47cda6aaa89057ef a6ce69c7df5253ee61f9ccc7ee95acc4 fbefaaf7c4807b38effc9ceba6df058b
    """,
    "CC0-1.0": """
        43e102f03f0ba1f3849e9760e961c3d5 4a21b45b899538bca79d37ae0579ffb2 8dc99cb54062faf94d2f69b0650eaf77 a4efb2565e300593b465814cab07de7b
        e41bbc2a2766c9ce02a539af73d82dd4
    """,
    "GPL-1.0": """
        3b9c9fac100f0c25f3385566a993256f 4095032937b9a3d514e75cb720c6f621 d471d97d7d638e3bb2f48588f9843aea d4cdb4cb4273c790a67bfc3537947400
        d80b61aeb6f9b88f2b23b8020a4b0a1f d9dac75c0d4f17619fd00bc56fa690d7
    """,
    "GPL-2.0": """
        0a4f7985b60337688949be7b80c4fc9c 31019ff02d98cb6ed1171bda19ed8cc4 5dc439d9dda11f9c0f5d22fbd98acbdb a7dc3301a43374a9260c72989365f83a
        b640f4e63811866dd42d9b35f47dcf55 e09481925e05c3f3d61d8ae9e9b02907
    """,
    "GPL-3.0": """
        3c7d4efde391fc7bf64a101e40fb98f4 3d847701494123d97eba0c565f13ebc2 3e488f4cd7a9782693c977db6bb5891c 5e95d9db503a4c33fb4f1d30af325c51
        6a74a88f61627120ad8f51a4af258521 e0410d41ed776dd16178a67b38283c7f e275b2360efa049d854ab18da16fc181 e5053c76b23b2500ad748082efc64465
    """,
    "LGPL-2.0": """
        15099806d770b4943ea8090774083f46 1eb0b1a08441ebeeb722f7bf821da785 2aee031bfd9fc3cbbb709a5a82b61be9 35b61b29d67414b5856fd65e7617d084
        43f183a230c886b7893f6884de2071f7 4f0f8218473427e1a3b745de6138b294
    """,
    "LGPL-2.1": """
        2467348371a0074f56bb1565ec7029b1 33556554ad0d2899e932064f2dcfd6f0 58ee1f006a45c2a26053f8f06d556818 60fe2eb3fc1d585e87c333d8d8f25c53
        6db1662213c1c74e0efdef50cf5c5943 9da597ae00fe6d5476b1e45a4fbffe6e
    """,
    "LGPL-3.0": """
        04d1dd9425fdf8605bc9c007e522cf3e 7c1005ecf85fe63271e0759a8844ada8
    """,
    "MPL-2.0": """
        0d0805ba33e2c8f00e1c157a04d0b873 47daab7b99aa07cc72294488182970a7 7c36c1b44eeb25d52e81c020792b94d9 bba58d76f66dd9d890110b970536045e
        c937efad55d73429bbb529d2de0d8f25 dd6e552f3a2884898067395596306743
    """,
    "Unlicense": """
        5135fd5b78e630c51de6dc53fa225c07 623ba9db93eda8991a1484472514bff3 7a8281dcef8a92e053f89f074496b3c0 9e62348bca93b9cfaa43b47c0f971d83
        b1bab096dab2ce6fa0aac09762a88032 b49f19dc4f59bb41cb1efb13b7db60c6 caae0071202747432ec7dc9a7c704f50 d8277de56acf642abb71da243c0bc00c
        de1c9109ab1d1f48f341e7555ec801b2
    """,
}
#: Pattern on normalised words and the spelling that stands for it.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("authorisation", "authorization"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("per cent", "percent"),
    ("and or", "or"),
    ("v", "version"),
)
#: A line that goes on with a sentence of a known text: "copyright" and a word that follows it there, or the item "(c)" of a
#: list. Which words follow is fixed; a holder's line has a sign, a year or a name instead.
FOLLOWING = r"and|are|also|disclaimers?|doctrines|holders?|if|interests?|laws?|licen[sc]es?|like|lines?|notices?|on|owners?|ownership|patent|permission|statements?|the[ \t]+(software|library)|those|treaty"
CONTINUED = rf"(?m)^[ \t]*(copyright([a-z]|[^a-z0-9\n(©]*(({FOLLOWING})\b|(the)?[ \t\r]*$))|\(c\)([ \t\r]*$|[ \t]+(you|under)\b))"
#: A line that names a holder alone: of the rest, it starts with "copyright", "(c)" or the sign.
COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"


def normalised(text: Column) -> Column:
    """Lower case, no holders' lines, every run of other than a-z and 0-9 one space, one spelling for equivalent ones."""
    own = F.regexp_replace(F.lower(text), CONTINUED, ". $1")  # no longer at the start of its line
    bare = F.trim(F.regexp_replace(F.regexp_replace(own, COPYRIGHT, "\n"), "[^a-z0-9]+", " "))
    for pattern, word in SPELLINGS:
        bare = F.regexp_replace(bare, rf"\b{pattern}\b", word)
    return bare


def digest(text: Column) -> Column:
    return F.md5(normalised(text).cast("binary"))


def known_digests(spark: SparkSession) -> DataFrame:
    """digest, license of the KNOWN texts and of DIGESTS: a fixed table."""
    rows = spark.createDataFrame(list(KNOWN), "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    long = spark.createDataFrame([(d, name) for name, all_of in DIGESTS.items() for d in all_of.split()], "digest string, license string")
    return rows.union(long).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the whole text), license (that the whole text is, or null), notices (names of licences of which a
    line is an entire known text, sorted, joined by commas), n_notices (how many names): one row a document.

    docs: doc_id and text among any other columns. A null text has null digest and no notice; an empty one has the
    digest of the empty text. Repeated rows each get their row. An empty table gives no rows.
    """
    known = F.broadcast(known_digests(docs.sparkSession))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = F.xxhash64("text").alias("key")
    whole = own.select("doc_id", key, digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    lines = own.select("doc_id", key, F.explode(F.split("text", "\n", -1)).alias("line"))
    hits = lines.select("doc_id", "key", digest(F.col("line")).alias("digest")).join(known, "digest")
    names = hits.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("license")).alias("names"))  # no more names than KNOWN has
    names = names.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "names")
    joined = whole.join(names, whole["doc_id"].eqNullSafe(F.col("_doc")) & (whole["key"] == F.col("_key")), "left")
    return joined.select("doc_id", "digest", "license", F.coalesce(F.array_join("names", ","), F.lit("")).alias("notices"), F.coalesce(F.when(F.col("names").isNotNull(), F.size("names")), F.lit(0)).cast("long").alias("n_notices"))
