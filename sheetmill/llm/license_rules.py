"""Hand-written signatures of licences, for ``license_scan``.

A line is ``label | class | keyword | pattern``. A pattern is a regular expression over words with one
blank between them (A-Z lower-cased, all other ASCII signs being separators); it always matches whole
words and has no capturing group. A text that does not contain the keyword cannot match; a keyword
between underscores must be a word of its own. Classes are ordered, the most certain first:

* ``tag``: a machine-readable identifier or the address of a licence;
* ``text``: a sentence of the licence itself;
* ``grant``: a statement that something is licensed so;
* ``name``: the name of a licence with its version;
* ``base``: the plain phrases whose every place is counted;
* ``hint``: words about licensing in general.
"""

from __future__ import annotations

from typing import NamedTuple

#: Priority (smaller wins) and confidence of the classes.
CLASSES = {"tag": (1, 1.0), "text": (2, 0.95), "grant": (3, 0.9), "name": (4, 0.75), "base": (5, 0.6), "hint": (6, 0.25)}


class Rule(NamedTuple):
    number: int
    label: str
    kind: str
    keyword: str
    pattern: str

    @property
    def priority(self) -> int:
        return CLASSES[self.kind][0]

    @property
    def weight(self) -> float:
        return CLASSES[self.kind][1]


SIGNATURES = r"""
gpl | base | general | gnu general public license
apache | base | apache | apache license
cc-by | base | _cc_ | cc by
mit | base | license | mit license

gpl-1.0 | tag | spdx | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0 | tag | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | tag | spdx | spdx license identifier gpl 2 0 or later
gpl-3.0 | tag | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | tag | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.0 | tag | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | tag | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | tag | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3.0 | tag | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | tag | spdx | spdx license identifier agpl 3 0(?: only| or later)?
apache-1.1 | tag | spdx | spdx license identifier apache 1 1
apache-2.0 | tag | spdx | spdx license identifier apache 2 0
mit | tag | spdx | spdx license identifier mit
mit-0 | tag | spdx | spdx license identifier mit 0
bsd-2-clause | tag | spdx | spdx license identifier bsd 2 clause(?: patent| views)?
bsd-3-clause | tag | spdx | spdx license identifier bsd 3 clause(?: clear| attribution)?
bsd-4-clause | tag | spdx | spdx license identifier bsd 4 clause(?: uc)?
0bsd | tag | spdx | spdx license identifier 0bsd
isc | tag | spdx | spdx license identifier isc
mpl-1.1 | tag | spdx | spdx license identifier mpl 1 1
mpl-2.0 | tag | spdx | spdx license identifier mpl 2 0(?: no copyleft exception)?
epl-1.0 | tag | spdx | spdx license identifier epl 1 0
epl-2.0 | tag | spdx | spdx license identifier epl 2 0
cddl-1.0 | tag | spdx | spdx license identifier cddl 1 0
cddl-1.1 | tag | spdx | spdx license identifier cddl 1 1
eupl-1.1 | tag | spdx | spdx license identifier eupl 1 1
eupl-1.2 | tag | spdx | spdx license identifier eupl 1 2
osl-3.0 | tag | spdx | spdx license identifier osl 3 0
afl-3.0 | tag | spdx | spdx license identifier afl 3 0
artistic-1.0 | tag | spdx | spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-2.0 | tag | spdx | spdx license identifier artistic 2 0
bsl-1.0 | tag | spdx | spdx license identifier bsl 1 0
zlib | tag | spdx | spdx license identifier zlib
unlicense | tag | spdx | spdx license identifier unlicense
wtfpl | tag | spdx | spdx license identifier wtfpl
cc0-1.0 | tag | spdx | spdx license identifier cc0 1 0
cc-by-3.0 | tag | spdx | spdx license identifier cc by 3 0
cc-by-4.0 | tag | spdx | spdx license identifier cc by 4 0
cc-by-sa-3.0 | tag | spdx | spdx license identifier cc by sa 3 0
cc-by-sa-4.0 | tag | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | tag | spdx | spdx license identifier cc by nc 4 0
cc-by-nd-4.0 | tag | spdx | spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 | tag | spdx | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | tag | spdx | spdx license identifier cc by nc nd 4 0
ofl-1.1 | tag | spdx | spdx license identifier ofl 1 1
python-2.0 | tag | spdx | spdx license identifier (?:python 2 0(?: 1)?|psf 2 0)
openssl | tag | spdx | spdx license identifier openssl
ncsa | tag | spdx | spdx license identifier ncsa
postgresql | tag | spdx | spdx license identifier postgresql
ms-pl | tag | spdx | spdx license identifier ms pl
ms-rl | tag | spdx | spdx license identifier ms rl
gfdl-1.3 | tag | spdx | spdx license identifier gfdl 1 3(?: only| or later)?

apache-1.1 | tag | apache | https?(?: www)? apache org licenses license 1 1
apache-2.0 | tag | apache | https?(?: www)? apache org licenses license 2 0(?: txt| html)?
gpl | tag | licenses | https?(?: www)? gnu org (?:licenses|copyleft) gpl(?: html| txt)?
gpl-2.0 | tag | licenses | https?(?: www)? gnu org licenses(?: old licenses)? gpl 2 0(?: en)?(?: html| txt)?
gpl-3.0 | tag | licenses | https?(?: www)? gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
lgpl | tag | licenses | https?(?: www)? gnu org (?:licenses|copyleft) (?:lgpl|lesser)(?: html| txt)?
lgpl-2.1 | tag | licenses | https?(?: www)? gnu org licenses(?: old licenses)? lgpl 2 1(?: en)?(?: html| txt)?
lgpl-3.0 | tag | licenses | https?(?: www)? gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?
agpl-3.0 | tag | licenses | https?(?: www)? gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?
gfdl | tag | licenses | https?(?: www)? gnu org (?:licenses|copyleft) fdl(?: 1 3)?(?: html| txt)?
mit | tag | opensource | https?(?: www)? opensource org licen[sc]es? mit(?: license)?(?: php| html)?
bsd-2-clause | tag | opensource | https?(?: www)? opensource org licen[sc]es? bsd 2 clause
bsd-3-clause | tag | opensource | https?(?: www)? opensource org licen[sc]es? bsd 3 clause
isc | tag | opensource | https?(?: www)? opensource org licen[sc]es? isc(?: license)?(?: txt)?
mpl-1.1 | tag | mozilla | https?(?: www)? mozilla org mpl mpl 1 1(?: html| txt)?
mpl-2.0 | tag | mozilla | https?(?: www)? mozilla org mpl 2 0
epl-1.0 | tag | eclipse | https?(?: www)? eclipse org legal epl v10(?: html)?
epl-2.0 | tag | eclipse | https?(?: www)? eclipse org legal epl (?:v20|2 0)(?: html)?
bsl-1.0 | tag | boost | https?(?: www)? boost org license 1 0(?: txt)?
unlicense | tag | unlicense | https?(?: www)? unlicense org
wtfpl | tag | wtfpl | https?(?: www)? wtfpl net
ofl | tag | _ofl_ | https? scripts sil org ofl
cc-by-2.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by 2 0
cc-by-3.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by 3 0
cc-by-4.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by 4 0
cc-by-sa-3.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by sa 4 0
cc-by-nc-3.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by nc 4 0
cc-by-nd-3.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0 | tag | creativecommons | https?(?: www)? creativecommons org licenses by nc nd 4 0
cc0-1.0 | tag | creativecommons | https?(?: www)? creativecommons org publicdomain zero 1 0
public-domain | tag | creativecommons | https?(?: www)? creativecommons org publicdomain mark 1 0
odbl-1.0 | tag | opendatacommons | https?(?: www)? opendatacommons org licenses odbl(?: 1 0| summary)?
odc-by-1.0 | tag | opendatacommons | https?(?: www)? opendatacommons org licenses by(?: 1 0| summary)?
pddl-1.0 | tag | opendatacommons | https?(?: www)? opendatacommons org licenses pddl(?: 1 0| summary)?

mit | text | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
isc | text | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | text | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd | text | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | text | endorse | neither the name of (?:the |[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | text | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
apache-2.0 | text | compliance | you may not use this file except in compliance with the license
apache-2.0 | text | writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl | text | redistribute | (?:this program|this library|it|[^ ]+) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0-or-later | text | redistribute | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | text | redistribute | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0 | text | redistribute | redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation
lgpl | text | redistribute | redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1-or-later | text | redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | text | redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0-or-later | text | redistribute | redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl | text | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
mpl-2.0 | text | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | text | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | text | eclipse | made available under the terms of the eclipse public license(?: v| version)? 1 0
epl-2.0 | text | eclipse | made available under the terms of the eclipse public license(?: v| version)? 2 0
cddl | text | development | the contents of this file are subject to the terms of the common development and distribution license
bsl-1.0 | text | hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 | text | boost | distributed under the boost software license version 1 0
zlib | text | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | text | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
unlicense | text | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | text | fuck | do what the fuck you want to public license
artistic | text | artistic | the artistic license preamble
cc0-1.0 | text | waived | to the extent possible under law (?:[^ ]+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights
cc-by-4.0 | text | attribution | licensed under a creative commons attribution 4 0 international license
cc-by-sa-4.0 | text | sharealike | licensed under a creative commons attribution sharealike 4 0 international license
cc-by-nc-4.0 | text | noncommercial | licensed under a creative commons attribution noncommercial 4 0 international license
cc-by-nd-4.0 | text | noderiv | licensed under a creative commons attribution noderiv(?:atives|s) 4 0 international license
cc-by-nc-sa-4.0 | text | sharealike | licensed under a creative commons attribution noncommercial sharealike 4 0 international license
cc-by-nc-nd-4.0 | text | noderiv | licensed under a creative commons attribution noncommercial noderiv(?:atives|s) 4 0 international license
ofl-1.1 | text | _font_ | this font software is licensed under the sil open font license version 1 1
openssl | text | openssl | this product includes software developed by the openssl project
python-2.0 | text | python | this license agreement is between the python software foundation
ncsa | text | illinois | developed by (?:[^ ]+ ){1,8}university of illinois at urbana champaign
postgresql | text | hereby | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | text | hereby | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted

gpl-1.0 | grant | general | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?gnu general public license(?: gpl)?(?: version| v)? (?:1|v1)(?: 0)?
gpl-2.0 | grant | general | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?gnu general public license(?: gpl)?(?: version| v)? (?:2|v2)(?: 0)?
gpl-3.0 | grant | general | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?gnu general public license(?: gpl)?(?: version| v)? (?:3|v3)(?: 0)?
gpl | grant | general | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?gnu general public licen[sc]e
gpl-2.0 | grant | gpl | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?(?:gplv2|gpl v2|gpl version 2|gpl 2)(?: 0)?
gpl-3.0 | grant | gpl | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?(?:gplv3|gpl v3|gpl version 3|gpl 3)(?: 0)?
gpl | grant | gpl | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?gpl
lgpl-2.1 | grant | general | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?gnu lesser general public license(?: version| v)? (?:2|v2) 1
lgpl-3.0 | grant | general | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?gnu lesser general public license(?: version| v)? (?:3|v3)(?: 0)?
lgpl | grant | lgpl | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?lgpl
agpl-3.0 | grant | affero | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?gnu affero general public license(?: version| v)? (?:3|v3)(?: 0)?
agpl | grant | agpl | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?agpl
apache-1.1 | grant | apache | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?apache(?: software)? license(?: version| v)? (?:1|v1) 1
apache-2.0 | grant | apache | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?apache(?: software)? license(?: version| v)? (?:2|v2)(?: 0)?
apache-2.0 | grant | apache | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?apache (?:2|v2)(?: 0)?(?: license)?
apache | grant | apache | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?apache licen[sc]e
mit | grant | licen | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |an )?mit(?: x11)?(?: open source)?(?: style)? licen[sc]e
mit | grant | licen | (?:licensed|released|distributed|available|published) under (?:the )?(?:x11|expat) licen[sc]e
bsd-2-clause | grant | _bsd_ | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |a )?(?:2|two) clause bsd(?: style)?(?: licen[sc]e)?
bsd-3-clause | grant | _bsd_ | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |a )?(?:3|three) clause bsd(?: style)?(?: licen[sc]e)?
bsd | grant | _bsd_ | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |a )?(?:new |revised |simplified |modified )?bsd(?: style)?(?: licen[sc]e)?
isc | grant | _isc_ | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?isc licen[sc]e
mpl-1.1 | grant | mozilla | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?mozilla public license(?: version| v)? (?:1|v1) 1
mpl-2.0 | grant | mozilla | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?mozilla public license(?: version| v)? (?:2|v2)(?: 0)?
mpl | grant | _mpl_ | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?mpl
epl | grant | eclipse | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?eclipse public license
zlib | grant | zlib | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?zlib(?: libpng)? licen[sc]e
unlicense | grant | unlicense | (?:licensed|released|distributed|available|published) (?:under|into|by) (?:the )?unlicense
public-domain | grant | domain | (?:released|dedicated|placed|published|put) (?:in|into|to|in to) the public domain
cc0-1.0 | grant | cc0 | (?:licensed|released|distributed|available|published|dedicated) under (?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by-2.0 | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by (?:2|v2)(?: 0)?
cc-by-3.0 | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by (?:3|v3)(?: 0)?
cc-by-4.0 | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by (?:4|v4)(?: 0)?
cc-by-sa-3.0 | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by sa (?:3|v3)(?: 0)?
cc-by-sa-4.0 | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by sa (?:4|v4)(?: 0)?
cc-by-nc-3.0 | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nc (?:3|v3)(?: 0)?
cc-by-nc-4.0 | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nc (?:4|v4)(?: 0)?
cc-by-nd-4.0 | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nd (?:4|v4)(?: 0)?
cc-by-nc-sa-4.0 | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nc sa (?:4|v4)(?: 0)?
cc-by-nc-nd-4.0 | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nc nd (?:4|v4)(?: 0)?
cc-by-sa | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by sa
cc-by-nc | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nc
cc-by-nd | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nd
cc-by-nc-sa | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nc sa
cc-by-nc-nd | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nc nd
cc-by | grant | _cc_ | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by
ofl | grant | _font_ | (?:licensed|released|distributed|available|published) under (?:the )?(?:sil )?open font license
odbl | grant | database | (?:licensed|released|distributed|available|published) under (?:the )?open (?:data commons )?(?:open )?database license

gpl-1.0 | name | general | gnu general public license(?: gpl)?(?: version| v)? (?:1|v1)(?: 0)?
gpl-2.0 | name | general | gnu general public license(?: gpl)?(?: version| v)? (?:2|v2)(?: 0)?
gpl-3.0 | name | general | gnu general public license(?: gpl)?(?: version| v)? (?:3|v3)(?: 0)?
gpl-2.0 | name | gpl | (?:gplv2|gpl v2|gpl 2 0)(?: only)?
gpl-2.0-or-later | name | gpl | (?:gplv2|gpl v2|gpl 2 0) (?:or later|plus)
gpl-3.0 | name | gpl | (?:gplv3|gpl v3|gpl 3 0)(?: only)?
gpl-3.0-or-later | name | gpl | (?:gplv3|gpl v3|gpl 3 0) (?:or later|plus)
lgpl-2.1 | name | general | gnu lesser general public license(?: version| v)? (?:2|v2) 1
lgpl-3.0 | name | general | gnu lesser general public license(?: version| v)? (?:3|v3)(?: 0)?
lgpl | name | general | gnu (?:lesser|library) general public licen[sc]e
lgpl-2.1 | name | lgpl | (?:lgplv2 1|lgpl v2 1|lgpl 2 1)
lgpl-3.0 | name | lgpl | (?:lgplv3|lgpl v3|lgpl 3 0)
agpl-3.0 | name | agpl | (?:agplv3|agpl v3|agpl 3 0)
agpl-3.0 | name | affero | affero general public license(?: version| v)? (?:3|v3)(?: 0)?
agpl | name | affero | affero general public licen[sc]e
gfdl | name | documentation | gnu free documentation licen[sc]e
apache-1.1 | name | apache | apache(?: software)? license(?: version| v)? (?:1|v1) 1
apache-2.0 | name | apache | apache(?: software)? license(?: version| v)? (?:2|v2)(?: 0)?
apache-2.0 | name | apache | (?:apache 2 0|asl 2 0)
mit-0 | name | attribution | mit no attribution(?: license)?
mit | name | licen | the mit licen[sc]e(?: mit)?
mit | name | licen | (?:x11|expat|mit x11) licen[sc]e
bsd-2-clause | name | _bsd_ | (?:(?:2|two) clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: licen[sc]e)
bsd-3-clause | name | _bsd_ | (?:(?:3|three) clause bsd|bsd 3 clause|new bsd|revised bsd|modified bsd)(?: licen[sc]e)?
bsd-4-clause | name | _bsd_ | (?:(?:4|four) clause bsd|bsd 4 clause|original bsd)(?: licen[sc]e)?
bsd | name | _bsd_ | bsd(?: style)? licen[sc]e
isc | name | _isc_ | isc licen[sc]e
mpl-1.1 | name | mozilla | mozilla public license(?: version| v)? (?:1|v1) 1
mpl-2.0 | name | mozilla | mozilla public license(?: version| v)? (?:2|v2)(?: 0)?
mpl | name | mozilla | mozilla public licen[sc]e
mpl-2.0 | name | _mpl_ | mpl(?: v)? 2 0
epl-1.0 | name | eclipse | eclipse public license(?: version| v)? 1 0
epl-2.0 | name | eclipse | eclipse public license(?: version| v)? 2 0
epl | name | eclipse | eclipse public licen[sc]e
cddl | name | development | common development and distribution licen[sc]e
cpl-1.0 | name | common | common public license(?: version)? 1 0
eupl | name | european | european union public licen[sc]e
osl-3.0 | name | licen | open software license(?: version| v)? 3 0
afl-3.0 | name | academic | academic free license(?: version| v)? 3 0
artistic-2.0 | name | artistic | artistic license(?: version)? 2 0
artistic | name | artistic | (?:perl |clarified )?artistic licen[sc]e
bsl-1.0 | name | boost | boost software licen[sc]e(?: version)?(?: 1 0)?
busl-1.1 | name | business | business source license(?: version)? 1 1
sspl-1.0 | name | server | server side public licen[sc]e
elastic-2.0 | name | elastic | elastic license(?: version)? 2 0
zlib | name | zlib | zlib(?: libpng)? licen[sc]e
wtfpl | name | wtfpl | wtfpl(?: version 2)?
ofl-1.1 | name | _font_ | sil open font license(?: version)? 1 1
ofl | name | _font_ | (?:sil )?open font licen[sc]e
python-2.0 | name | python | python software foundation license(?: version 2)?
ncsa | name | illinois | university of illinois ncsa open source license
ms-pl | name | microsoft | microsoft public license(?: ms pl)?
ms-rl | name | microsoft | microsoft reciprocal license(?: ms rl)?
openssl | name | openssl | openssl licen[sc]e
php-3.01 | name | _php_ | php license(?: version)? 3 01
ruby | name | _ruby_ | ruby licen[sc]e
vim | name | _vim_ | vim licen[sc]e
beerware | name | beerware | beerware licen[sc]e
cc0-1.0 | name | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | name | creative | creative commons zero(?: v1 0)?(?: universal)?
cc-by-nc-sa | name | _cc_ | cc by nc sa(?: [1-4](?: 0)?)?
cc-by-nc-nd | name | _cc_ | cc by nc nd(?: [1-4](?: 0)?)?
cc-by-sa | name | _cc_ | cc by sa(?: [1-4](?: 0)?)?
cc-by-nc | name | _cc_ | cc by nc(?: [1-4](?: 0)?)?
cc-by-nd | name | _cc_ | cc by nd(?: [1-4](?: 0)?)?
cc-by | name | _cc_ | cc by [1-4](?: 0)?
cc-by-nc-sa | name | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?
cc-by-nc-nd | name | noderiv | creative commons attribution non ?commercial noderiv(?:atives|s|ative works)(?: [1-4] 0)?
cc-by-sa | name | creative | creative commons attribution share ?alike(?: [1-4] 0)?
cc-by-nc | name | creative | creative commons attribution non ?commercial(?: [1-4] 0)?
cc-by-nd | name | noderiv | creative commons attribution noderiv(?:atives|s|ative works)(?: [1-4] 0)?
cc-by | name | creative | creative commons attribution(?: [1-4] 0)?(?: licen[sc]e)?
odbl | name | database | open database licen[sc]e
ogl-3.0 | name | government | open government licen[sc]e(?: v3 0)?
proprietary | name | proprietary | (?:proprietary and confidential|proprietary licen[sc]e)

proprietary | hint | reserved | all rights reserved
public-domain | hint | domain | public domain
unknown-license | hint | licen | (?:licensed|released|distributed) under (?:the |a |an )?(?:terms|licen[sc]e)
unknown-license | hint | licen | (?:see|refer to) (?:the )?(?:accompanying )?licen[sc]e(?: file| txt)?
unknown-license | hint | licen | licen[sc]e agreement
"""


def rules() -> list[Rule]:
    """All signatures in the order in which they stand, which is also the order among equals."""
    rows = [[part.strip() for part in line.split(" | ")] for line in SIGNATURES.splitlines() if line.strip()]
    return [Rule(n, label, kind, keyword.replace("_", " "), pattern) for n, (label, kind, keyword, pattern) in enumerate(rows)]
