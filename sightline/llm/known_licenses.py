"""Digests of whole licence texts in canonical form, made by ``license_digests.build`` from the files of Debian's /usr/share/common-licenses.

Each text as it is and, where it says so, up to the end of its terms. SOURCES names the file of each.
"""

SOURCES = {
    "Apache-2.0": "Apache-2.0",
    "Artistic-1.0-Perl": "Artistic",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3",
    "GPL-1.0": "GPL-1",
    "GPL-2.0": "GPL-2",
    "GPL-3.0": "GPL-3",
    "LGPL-2.0": "LGPL-2",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3.0": "LGPL-3",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}

#: SHA-256 by licence.
DIGESTS = {
    "Apache-2.0": (
        "2c6795903d07f17a9f31d7fa5893fd2b9869a7f88ca3c0e35f1dc2816119bc7a",
        "aa0a88694b449fe5b369aa038a940acea4c4ad864b21c87517686cf259e444bf",
        "dadd1ce898a91ab136da8b4ccb706b024f552b17d898e88eca4bf995f33188b3",
    ),
    "Artistic-1.0-Perl": (
        "aaeb9e3c0971c6a124d527a024ea2026a1690909a015bfc0fb21761e1cfaf766",
    ),
    "CC0-1.0": (
        "4d364ff0dab9e885ab3e1f042d84cf93e3ee03308ea07c332f1ec94f3491cf2f",
    ),
    "GFDL-1.2": (
        "3e3076bdd45cbc3700b57359b8556a8a86bc4822a9e08f20aab670d4a716d40f",
    ),
    "GFDL-1.3": (
        "90f4f2e7a53aa20e622ba7821c11064dec9017b053ce0b7ca86be893535b9245",
    ),
    "GPL-1.0": (
        "112cb0e9e3ebfa0bd97532a8edc8d0d85d6a5738fd4f597a58fe108139edb431",
        "55285436e9ae2c0893f8a4f5857e06688e84425826361f87f275d6a02e627ebf",
        "79471c0969fb8776590594ab68d8eecf64bbf043461ebe1b2c016bb77b545305",
    ),
    "GPL-2.0": (
        "095e328163f99cef213c16812f33504ad2ef020dc55f4f35a35935d99b28be5c",
        "2ad52ac848664db7937e4ad76a8fd53923077d623d438add86f2fe33b44e058d",
        "40942dd72eed70c7102e5575fcbb2e6d2dfd374eb9a6a9a7953ed3f2e73e7a2d",
    ),
    "GPL-3.0": (
        "52f656af64e7e54a758b40cc2cad5596ad92abbe15c7f11b387779c4a07fdae0",
        "7e4e9e3f9b0e135fa8d2ca62df8945328a073204093730a9586f991ae7d68e07",
        "eb132db27a8e5a309335ce5ed9805ec38c540dd60497f3f3e13412d82d5155a3",
    ),
    "LGPL-2.0": (
        "1e3e3dd4ce163370479bbc9b94dc1de2ab2d1ca9041f0d5747527a0f69cf86e7",
        "409f87802d10f252d44255872e64b88d8b29a1aa95500f6b30d882ba293c3c50",
        "6c1db4e4828cce87ca139d112ab547fc8fb5d949020e6a44bf87cd2b7959f5e7",
    ),
    "LGPL-2.1": (
        "4cdeb721f97da1e05ca600ba74a77254180373a3c52e7c5a9a80c1169243a54c",
        "c5e813830bda5a726d93d1706b43d5fc05622f0d43d40a9d8c4de3e50d99619a",
        "eccc01f482a6a6cbac73d19d6d3c4349e4275197e0f73f44d2603191f030cadf",
    ),
    "LGPL-3.0": (
        "3d6e6acd42330c52e014052109e327033ab60b7769d0950a59d9dd685aa1b43b",
    ),
    "MPL-1.1": (
        "ec234fe536f7828f67d115bea89d26e9af83e3f04e8735f7b451704d90eb4069",
    ),
    "MPL-2.0": (
        "15dc8e8673fb83f54651ca7a236121b37fc1e8dd224162ee304b6781156be49f",
    ),
}
