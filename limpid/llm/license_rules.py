"""The license signatures: families written by hand, spelled out into ordered rules.

Texts are matched as lower-case words with single blanks around them, so "GPL-3.0"
reads ``gpl 3 0``. A family has a label, the names it goes by (regular expressions
over words) and its versions. Every family gives rules of four kinds, from the
strongest: identifier lines, names with a version, grants ("licensed under ..."),
bare names. SPDX short identifiers are a list of their own; in an expression each
known one is found, up to the first that the list does not hold. Smaller tiers suppress larger ones that lie inside them.

Every name is gated by the first keyword of its family that stands in all its spellings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# label, keywords (without the one it holds, no rule of a name can match), names, versions
FAMILIES = [
    ("agpl", [" affero "], ["(gnu )?affero general public license", "(gnu )?affero gpl"], ["1 0", "2 0", "3 0", "3"]),
    ("agpl", [" agpl"], ["agpl", "agplv3", "agpl 3"], ["1 0", "3 0", "3"]),
    ("apache", [" apache ", " asf "], ["apache license", "apache software license", "apache public license", "asf license"], ["1 0", "1 1", "2 0", "2"]),
    ("apache", [" apache2 "], ["apache2", "apache2 license"], ["0"]),
    ("artistic", [" artistic "], ["artistic license", "perl artistic license", "clarified artistic license"], ["1 0", "2 0"]),
    ("bsd", [" bsd ", " berkeley "], ["bsd license", "bsd style license", "berkeley software distribution", "modified bsd license", "new bsd license", "simplified bsd license"], ["0 clause", "1 clause", "2 clause", "3 clause", "4 clause"]),
    ("boost", [" boost "], ["boost software license", "boost license"], ["1 0"]),
    ("cc-by", [" cc "], ["cc by"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", [" cc "], ["cc by sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", [" cc "], ["cc by nc"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", [" cc "], ["cc by nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", [" cc "], ["cc by nc sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", [" cc "], ["cc by nc nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc0", [" cc0 "], ["cc0", "cc0 universal"], ["1 0"]),
    ("cc", [" creative commons "], ["creative commons license", "creative commons public license"], ["2 0", "3 0", "4 0"]),
    ("cc-by", [" creative commons "], ["creative commons attribution( license| international| unported| generic)?"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", [" creative commons "], ["creative commons attribution share ?alike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", [" creative commons "], ["creative commons attribution non ?commercial"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc0", [" creative commons "], ["creative commons zero"], ["1 0"]),
    ("cddl", [" cddl "], ["cddl"], ["1 0", "1 1"]),
    ("cddl", [" common development "], ["common development and distribution license"], ["1 0", "1 1"]),
    ("cpl", [" common public "], ["common public license"], ["0 5", "1 0"]),
    ("epl", [" eclipse "], ["eclipse public license", "eclipse distribution license"], ["1 0", "2 0"]),
    ("eupl", [" european union "], ["european union public licen[cs]e"], ["1 0", "1 1", "1 2"]),
    ("gfdl", [" gnu free "], ["gnu free documentation license"], ["1 1", "1 2", "1 3"]),
    ("gpl", [" gnu general "], ["gnu general public license"], ["1", "1 0", "2", "2 0", "3", "3 0"]),
    ("gpl", [" gpl"], ["gpl", "gnu gpl", "gplv2", "gplv3"], ["1", "1 0", "2", "2 0", "3", "3 0"]),
    ("gpl", [" general public "], ["general public license"], ["1", "2", "3"]),
    ("isc", [" isc ", " internet systems "], ["isc license", "isc style license", "internet systems consortium license"], []),
    ("lgpl", [" lesser "], ["(gnu )?lesser general public license"], ["2 1", "3", "3 0"]),
    ("lgpl", [" library general "], ["(gnu )?library general public license"], ["2", "2 0"]),
    ("lgpl", [" lgpl"], ["lgpl", "gnu lgpl", "lgplv2", "lgplv3"], ["2", "2 0", "2 1", "3", "3 0"]),
    ("mit", [" mit "], ["mit license", "mit style license", "mit x11 license", "x11 mit license", "expat mit license"], []),
    ("mit-0", [" mit "], ["mit no attribution( license)?", "mit 0"], []),
    ("mpl", [" mozilla "], ["mozilla public license"], ["1 0", "1 1", "2 0", "2"]),
    ("mpl", [" mpl "], ["mpl"], ["1 0", "1 1", "2 0", "2"]),
    ("ms-pl", [" microsoft "], ["microsoft public license", "microsoft permissive license"], []),
    ("ms-rl", [" microsoft "], ["microsoft reciprocal license"], []),
    ("ncsa", [" ncsa "], ["university of illinois ncsa open source license", "ncsa license"], []),
    ("odbl", [" open "], ["open database license", "open data commons open database license"], ["1 0"]),
    ("ofl", [" open "], ["sil open font license", "open font license"], ["1 0", "1 1"]),
    ("osl", [" open "], ["open software license"], ["1 0", "2 0", "2 1", "3 0"]),
    ("openssl", [" openssl "], ["openssl license", "openssl ssleay license"], []),
    ("postgresql", [" postgresql "], ["postgresql license", "postgresql licence"], []),
    ("psf", [" python ", " psf "], ["python software foundation license", "psf license", "python license"], ["2", "2 0"]),
    ("public-domain", [" public domain "], ["released into the public domain", "dedicated to the public domain", "placed in the public domain", "is in the public domain", "public domain dedication"], []),
    ("ruby", [" ruby "], ["ruby license", "ruby s license"], []),
    ("unlicense", [" unlicense "], ["the unlicense", "unlicense"], []),
    ("vim", [" vim "], ["vim license", "vim charityware"], []),
    ("w3c", [" w3c "], ["w3c software notice and license", "w3c license", "w3c software license"], []),
    ("wtfpl", [" wtfpl "], ["wtfpl"], ["2", "2 0"]),
    ("zlib", [" zlib "], ["zlib license", "zlib libpng license"], []),
    ("zpl", [" zope "], ["zope public license"], ["1 1", "2 0", "2 1"]),
    ("proprietary", [" all rights "], ["all rights reserved"], []),
    ("proprietary", [" proprietary "], ["proprietary license", "proprietary and confidential", "confidential and proprietary"], []),
    ("permission-notice", [" permission is ", " permission to use "], ["permission is hereby granted free of charge to any person", "permission to use copy modify and or distribute this software"], []),
    ("redistribution", [" redistribution "], ["redistribution and use in source and binary forms"], []),
    ("warranty", [" warranty "], ["without warranty of any kind", "provided as is without warranty"], []),
    ("license", [" license "], ["open source license", "free software license", "public license", "software license agreement", "end user license agreement", "under the terms of the license", "see the license for details", "license file"], ["1 0", "2 0", "3 0"]),
]
# label, SPDX short identifiers as words; "only" and "or later" may follow any of them
SPDX = [
    ("agpl", ["agpl 1 0", "agpl 3 0"]),
    ("apache", ["apache 1 0", "apache 1 1", "apache 2 0"]),
    ("artistic", ["artistic 1 0", "artistic 1 0 cl8", "artistic 1 0 perl", "artistic 2 0", "clartistic"]),
    ("bsd", ["0bsd", "bsd 1 clause", "bsd 2 clause", "bsd 2 clause patent", "bsd 2 clause views", "bsd 2 clause freebsd", "bsd 2 clause netbsd", "bsd 3 clause", "bsd 3 clause attribution", "bsd 3 clause clear", "bsd 3 clause lbnl", "bsd 3 clause modification", "bsd 3 clause no nuclear license", "bsd 3 clause open mpi", "bsd 4 clause", "bsd 4 clause shortened", "bsd 4 clause uc", "bsd protection", "bsd source code"]),
    ("boost", ["bsl 1 0"]),
    *((f"cc-{kind}", [f"cc {kind.replace('-', ' ')} {v}" for v in ("1 0", "2 0", "2 5", "3 0", "4 0")]) for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")),
    ("cc-by-nc-nd", ["cc by nd nc 1 0"]),
    ("cc0", ["cc0 1 0"]),
    ("cddl", ["cddl 1 0", "cddl 1 1"]),
    ("cpl", ["cpl 1 0"]),
    ("epl", ["epl 1 0", "epl 2 0"]),
    ("eupl", ["eupl 1 0", "eupl 1 1", "eupl 1 2"]),
    ("gfdl", [f"gfdl {v}{kind}" for v in ("1 1", "1 2", "1 3") for kind in ("", " invariants", " no invariants")]),
    ("gpl", ["gpl 1 0", "gpl 2 0", "gpl 2 0 with autoconf exception", "gpl 2 0 with bison exception", "gpl 2 0 with classpath exception", "gpl 2 0 with font exception", "gpl 2 0 with gcc exception", "gpl 3 0", "gpl 3 0 with autoconf exception", "gpl 3 0 with gcc exception"]),
    ("isc", ["isc", "isc veillard"]),
    ("lgpl", ["lgpl 2 0", "lgpl 2 1", "lgpl 3 0"]),
    ("mit", ["mit", "mit advertising", "mit cmu", "mit enna", "mit feh", "mit festival", "mit modern variant", "mit open group", "mit wu", "mitnfa", "x11", "x11 distribute modifications variant"]),
    ("mit-0", ["mit 0"]),
    ("mpl", ["mpl 1 0", "mpl 1 1", "mpl 2 0", "mpl 2 0 no copyleft exception"]),
    ("ms-pl", ["ms pl"]),
    ("ms-rl", ["ms rl"]),
    ("ncsa", ["ncsa"]),
    ("odbl", ["odbl 1 0"]),
    ("ofl", ["ofl 1 0", "ofl 1 0 no rfn", "ofl 1 0 rfn", "ofl 1 1", "ofl 1 1 no rfn", "ofl 1 1 rfn"]),
    ("openssl", ["openssl", "openssl standalone"]),
    ("osl", ["osl 1 0", "osl 1 1", "osl 2 0", "osl 2 1", "osl 3 0"]),
    ("postgresql", ["postgresql"]),
    ("psf", ["psf 2 0", "python 2 0", "python 2 0 1"]),
    ("public-domain", ["pddl 1 0", "cc pddc"]),
    ("ruby", ["ruby", "ruby pty"]),
    ("unlicense", ["unlicense"]),
    ("vim", ["vim"]),
    ("w3c", ["w3c", "w3c 19980720", "w3c 20150513"]),
    ("wtfpl", ["wtfpl"]),
    ("zlib", ["zlib", "zlib acknowledgement"]),
    ("zpl", ["zpl 1 1", "zpl 2 0", "zpl 2 1"]),
]
# fixed values: the phrases of the contract and their labels
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

GRANT = r"(?:licen[cs]ed|released|distributed|available|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"


@dataclass(frozen=True)
class Rule:
    rule: str
    label: str
    tier: int
    keyword: str
    regex: str
    base: bool = False


def _whole(words: str) -> str:
    """The pattern between blanks; the blank behind stays for the next match."""
    return f"(?<= )(?:{words})(?= )"


def spellings(name: str) -> list[str]:
    """All strings that the pattern of a name stands for."""
    m = re.search(r"\(([^()]*)\)\?|\[(\w+)\]|(.)\?", name)
    if m is None:
        return [name]
    options = list(m[2]) if m[2] else ["", *(m[1] or m[3]).split("|")]
    return [s for o in options for s in spellings(name[:m.start()] + o + name[m.end():])]


def _keyword(name: str, keywords: list[str]) -> str:
    held = [k for k in keywords if all(k in f" {s} " for s in spellings(name))]
    if not held:
        raise ValueError(f"no keyword of {keywords} stands in every spelling of {name!r}")
    return held[0]


LATER = "(?: or (?:any )?later(?: version)?)?"


def _counted(name: str, version: str) -> str:
    """More spellings: the version in front of "license", a clause count also in front of the name or last."""
    forms = []
    if m := re.fullmatch(r"(.+)( licen(?:s|\[cs\])e)", name):
        behind = f"(?:(?: [a-z]+(?: or [a-z]+)?)?{m[2]})?" if version.endswith(" clause") else m[2]
        forms.append(f"(?:{m[1]})(?: version| v)? v?{version}{behind}{LATER}")
    if version.endswith(" clause"):
        forms.append(f"{version} (?:{name})")
    return "".join(f"|{f}" for f in forms)


def _no_longer(words: str, label: str, label_of: dict[str, str]) -> str:
    """Not in front of what would make it another family's words ("cc by" in "cc by sa")."""
    longer = "|".join(x[len(words) + 1:] for x in label_of if x.startswith(f"{words} ") and label_of[x] != label)
    return f"(?! (?:{longer})(?= ))" if longer else ""


def _spdx_rules() -> list[Rule]:
    """One rule per short identifier; identifiers that stand in front of it in the same expression are passed over."""
    label_of = {words: label for label, ids in SPDX for words in ids}
    later = "(?: only| or later)?"
    one = "|".join(sorted(label_of, key=len, reverse=True))
    passed = f"(?:(?:{one}){later}(?: with (?:[^ ]+ ){{1,5}}?exception(?: [0-9]+)*)? (?:or|and) )*"
    rules = []
    for words, label in label_of.items():
        rules.append(Rule(f"spdx {words}", label, 1, " spdx ", _whole(f"spdx license identifier {passed}{words}{_no_longer(words, label, label_of)}{later}")))
    return rules


def build_rules() -> list[Rule]:
    rules = [Rule(f"base {phrase}", label, 0, f" {phrase} ", _whole(phrase), True) for phrase, label in BASE]
    label_of = {name: family[0] for family in FAMILIES for name in family[2]}
    for n, (label, keywords, names, versions) in enumerate(FAMILIES):
        for k, name in enumerate(names):
            at, keyword = f"{label} {n} {k}", _keyword(name, keywords)
            rules.append(Rule(f"{at} identifier", label, 1, " spdx ", _whole(f"spdx license identifier {name}{_no_longer(name, label, label_of)}(?: [0-9]+)*(?: only| or later)?")))
            for version in versions:
                spelled = f"(?:{name})(?: license)?(?: version| v)? v?{version}{LATER}(?! [0-9]){_counted(name, version)}"
                rules.append(Rule(f"{at} {version}", f"{label}-{version.replace(' ', '.')}", 2, keyword, _whole(spelled)))
            rules.append(Rule(f"{at} grant", label, 3, keyword, _whole(f"{GRANT}(?:{name})")))
            rules.append(Rule(f"{at} name", label, 4, keyword, _whole(name)))
    return rules + _spdx_rules()


TIER_SCORE = {0: 0.9, 1: 1.0, 2: 0.95, 3: 0.8, 4: 0.5}
