"""Signature rules of the license scan, hand-written, in order of priority.

A rule is ``level | label | keyword | regex``. The regex runs over the document's lower-cased words joined by single
spaces and has to match whole words; ``keyword`` is one word (or words in a row) without which it isn't tried. Level 0
holds titles and grants that name their license in full, level 1 tags and short grants, level 2 sentences typical of
a family, level 3 bare mentions. Within a level earlier rules win.
"""

TABLE = """
0 | agpl-3-or-later | affero | gnu affero general public license (?:version |v ?)?3(?: 0)? or (?:any )?later(?: version)?
0 | agpl-3 | affero | gnu affero general public license (?:as published by the free software foundation )?(?:version |v ?)?3(?: 0)?
0 | agpl-1 | affero | affero general public license (?:version |v ?)?1(?: 0)?
0 | lgpl-2-or-later | library | gnu library general public license (?:as published by the free software foundation )?(?:either )?version 2 (?:of the license )?or (?:at your option )?any later version
0 | lgpl-2 | library | gnu library general public license (?:version |v ?)?2(?: 0)?
0 | lgpl-2-1-or-later | lesser | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1 (?:of the license )?or (?:at your option )?any later version
0 | lgpl-2-1 | lesser | gnu lesser general public license (?:version |v ?)?2 1
0 | lgpl-3-or-later | lesser | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 3 (?:of the license )?or (?:at your option )?any later version
0 | lgpl-3 | lesser | gnu lesser general public license (?:version |v ?)?3(?: 0)?
0 | gpl-1-or-later | general | gnu general public license as published by the free software foundation either version 1 or (?:at your option )?any later version
0 | gpl-2-or-later | general | gnu general public license (?:as published by the free software foundation )?(?:either )?version 2 (?:of the license )?or (?:at your option )?any later version
0 | gpl-2-only | general | gnu general public license (?:as published by the free software foundation )?version 2 only
0 | gpl-2-classpath | classpath | gnu general public license version 2 (?:only )?with (?:the )?classpath exception
0 | gpl-2 | general | gnu general public license (?:version |v ?)?2(?: 0)?
0 | gpl-3-or-later | general | gnu general public license (?:as published by the free software foundation )?(?:either )?version 3 (?:of the license )?or (?:at your option )?any later version
0 | gpl-3-only | general | gnu general public license (?:as published by the free software foundation )?version 3 only
0 | gpl-3 | general | gnu general public license (?:version |v ?)?3(?: 0)?
0 | gfdl-1-3 | documentation | gnu free documentation license (?:version |v ?)?1 3
0 | gfdl-1-2 | documentation | gnu free documentation license (?:version |v ?)?1 2
0 | gfdl-1-1 | documentation | gnu free documentation license (?:version |v ?)?1 1
0 | apache-2 | apache | licensed under the apache license version 2(?: 0)?(?: the license)?
0 | apache-2 | apache | apache license version 2(?: 0)?(?: january 2004)?
0 | apache-1-1 | apache | apache (?:software )?license (?:version |v ?)?1 1
0 | apache-1-0 | apache | apache (?:software )?license (?:version |v ?)?1 0
0 | mpl-2 | mozilla | (?:this source code form is )?subject to the terms of the mozilla public license v 2 0
0 | mpl-2 | mozilla | mozilla public license (?:version |v ?)?2(?: 0)?
0 | mpl-1-1 | mozilla | mozilla public license (?:version |v ?)?1 1
0 | mpl-1-0 | mozilla | mozilla public license (?:version |v ?)?1 0
0 | epl-2 | eclipse | eclipse public license (?:version |v ?)?2(?: 0)?
0 | epl-1 | eclipse | eclipse public license (?:version |v ?)?1(?: 0)?
0 | edl-1 | eclipse | eclipse distribution license (?:version |v ?)?1(?: 0)?
0 | cddl-1-1 | distribution | common development and distribution license (?:cddl )?(?:version |v ?)?1 1
0 | cddl-1-0 | distribution | common development and distribution license (?:cddl )?(?:version |v ?)?1 0
0 | cpl-1 | common | common public license (?:version |v ?)?1 0
0 | cpal-1 | attribution | common public attribution license (?:version |v ?)?1 0
0 | eupl-1-2 | european | european union public licen[cs]e (?:version |v ?)?(?:v )?1 2
0 | eupl-1-1 | european | european union public licen[cs]e (?:version |v ?)?(?:v )?1 1
0 | osl-3 | open | open software license (?:version |v ?)?3 0
0 | osl-2-1 | open | open software license (?:version |v ?)?2 1
0 | afl-3 | academic | academic free license (?:version |v ?)?3 0
0 | afl-2-1 | academic | academic free license (?:version |v ?)?2 1
0 | artistic-2 | artistic | (?:the )?artistic license (?:version |v ?)?2 0
0 | artistic-1 | artistic | (?:the )?artistic license (?:version |v ?)?1 0
0 | bsl-1 | boost | (?:distributed under the )?boost software license version 1 0
0 | busl-1-1 | business | business source license (?:version |v ?)?1 1
0 | sspl-1 | server | server side public license (?:version |v ?)?1
0 | elastic-2 | elastic | elastic license (?:version |v ?)?2 0
0 | polyform-nc | polyform | polyform noncommercial license (?:version )?1 0 0
0 | polyform-sb | polyform | polyform small business license (?:version )?1 0 0
0 | polyform-shield | polyform | polyform shield license (?:version )?1 0 0
0 | psf-2 | python | python software foundation license(?: version 2)?
0 | php-3-01 | php | (?:the )?php license version 3 01
0 | ruby | ruby | (?:the )?ruby license
0 | zpl-2-1 | zope | zope public license (?:zpl )?(?:version |v ?)?2 1
0 | w3c | w3c | w3c software (?:notice and license|and document notice and license)
0 | ms-pl | microsoft | microsoft public license(?: ms pl)?
0 | ms-rl | microsoft | microsoft reciprocal license(?: ms rl)?
0 | ofl-1-1 | font | sil open font license (?:version |v ?)?1 1
0 | ipl-1 | ibm | ibm public license (?:version |v ?)?1 0
0 | upl-1 | universal | universal permissive license (?:version |v ?)?1 0
0 | apsl-2 | apple | apple public source license (?:version |v ?)?2 0
0 | nasa-1-3 | nasa | nasa open source agreement (?:version |v ?)?1 3
0 | lppl-1-3c | latex | latex project public license (?:version |v ?)?1 3c?
0 | ecl-2 | educational | educational community license (?:version |v ?)?2 0
0 | mulan-2 | mulan | mulan permissive software license (?:version |v ?)?2
0 | cecill-2-1 | cecill | cecill free software license agreement(?: version 2 1)?
0 | odbl-1 | database | open (?:data commons open )?database license(?: v?1 0)?
0 | odc-by-1 | commons | open data commons attribution license(?: v?1 0)?
0 | pddl-1 | dedication | public domain dedication and license
0 | openrail-m | m | (?:creativeml|bigscience|bigcode) open ?rail m(?: license)?
0 | cc0 | cc0 | cc0 1 0 universal(?: public domain dedication)?
0 | cc-by-nc-nd-4 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?
0 | cc-by-nc-sa-4 | creative | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: license)?
0 | cc-by-nc-4 | creative | creative commons attribution non ?commercial 4 0(?: international)?(?: license)?
0 | cc-by-nd-4 | creative | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?
0 | cc-by-sa-4 | creative | creative commons attribution share ?alike 4 0(?: international)?(?: license)?
0 | cc-by-4 | creative | creative commons attribution 4 0(?: international)?(?: license)?
0 | cc-by-nc-nd-3 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0(?: unported)?(?: license)?
0 | cc-by-nc-sa-3 | creative | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: license)?
0 | cc-by-nc-3 | creative | creative commons attribution non ?commercial 3 0(?: unported)?(?: license)?
0 | cc-by-nd-3 | creative | creative commons attribution no ?deriv(?:ative)?s 3 0(?: unported)?(?: license)?
0 | cc-by-sa-3 | creative | creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
0 | cc-by-3 | creative | creative commons attribution 3 0(?: unported)?(?: license)?
0 | mit | mit | released under the mit license
0 | mit | mit | (?:is |are )?(?:licensed|distributed|available|provided) under the (?:terms of the )?mit license
0 | mit-0 | mit | mit no attribution(?: license)?
0 | bsd-4 | bsd | (?:original |4 clause |four clause )bsd license
0 | bsd-3 | bsd | (?:new |modified |revised |3 clause |three clause )bsd license
0 | bsd-3 | bsd | bsd 3 clause (?:new or revised )?(?:new )?license
0 | bsd-2 | bsd | (?:simplified |freebsd |2 clause |two clause )bsd license
0 | bsd-2 | bsd | bsd 2 clause (?:simplified )?license
0 | bsd-1 | bsd | bsd 1 clause license
0 | 0bsd | bsd | (?:zero clause bsd|bsd zero clause)(?: license)?
0 | isc | isc | (?:the )?isc license
0 | zlib | zlib | (?:the )?zlib (?:libpng )?license
0 | libpng | png | (?:the )?png reference library license(?: version 2)?
0 | unlicense | unlicense | (?:released under )?the unlicense
0 | wtfpl | want | do what the fuck you want to public license
0 | beerware | license | (?:the )?beer ?ware license
0 | x11 | x11 | (?:the )?x11 license
0 | ncsa | ncsa | university of illinois ncsa open source license
0 | postgresql | postgresql | (?:the )?postgresql licen[cs]e
0 | openssl | openssl | (?:the )?openssl license
0 | curl | curl | (?:the )?curl license
0 | vim | vim | (?:the )?vim license
0 | sleepycat | sleepycat | (?:the )?sleepycat license
0 | llama-2 | llama | llama 2 community license(?: agreement)?
0 | llama-3 | llama | (?:meta )?llama 3(?: [123])? community license(?: agreement)?
0 | gemma | gemma | gemma terms of use
1 | apache-2 | spdx | spdx license identifier apache 2 0
1 | mit | spdx | spdx license identifier mit
1 | mit-0 | spdx | spdx license identifier mit 0
1 | bsd-2 | spdx | spdx license identifier bsd 2 clause
1 | bsd-3 | spdx | spdx license identifier bsd 3 clause
1 | bsd-4 | spdx | spdx license identifier bsd 4 clause
1 | 0bsd | spdx | spdx license identifier 0bsd
1 | gpl-2-only | spdx | spdx license identifier gpl 2 0(?: only)?
1 | gpl-2-or-later | spdx | spdx license identifier gpl 2 0 or later
1 | gpl-3-only | spdx | spdx license identifier gpl 3 0(?: only)?
1 | gpl-3-or-later | spdx | spdx license identifier gpl 3 0 or later
1 | lgpl-2-1-only | spdx | spdx license identifier lgpl 2 1(?: only)?
1 | lgpl-2-1-or-later | spdx | spdx license identifier lgpl 2 1 or later
1 | lgpl-3-only | spdx | spdx license identifier lgpl 3 0(?: only)?
1 | lgpl-3-or-later | spdx | spdx license identifier lgpl 3 0 or later
1 | agpl-3-only | spdx | spdx license identifier agpl 3 0(?: only)?
1 | agpl-3-or-later | spdx | spdx license identifier agpl 3 0 or later
1 | mpl-2 | spdx | spdx license identifier mpl 2 0
1 | mpl-1-1 | spdx | spdx license identifier mpl 1 1
1 | epl-2 | spdx | spdx license identifier epl 2 0
1 | epl-1 | spdx | spdx license identifier epl 1 0
1 | cddl-1-0 | spdx | spdx license identifier cddl 1 0
1 | isc | spdx | spdx license identifier isc
1 | zlib | spdx | spdx license identifier zlib
1 | bsl-1 | spdx | spdx license identifier bsl 1 0
1 | unlicense | spdx | spdx license identifier unlicense
1 | wtfpl | spdx | spdx license identifier wtfpl
1 | artistic-2 | spdx | spdx license identifier artistic 2 0
1 | ofl-1-1 | spdx | spdx license identifier ofl 1 1
1 | eupl-1-2 | spdx | spdx license identifier eupl 1 2
1 | cc0 | spdx | spdx license identifier cc0 1 0
1 | cc-by-4 | spdx | spdx license identifier cc by 4 0
1 | cc-by-sa-4 | spdx | spdx license identifier cc by sa 4 0
1 | cc-by-nc-4 | spdx | spdx license identifier cc by nc 4 0
1 | cc-by-nc-sa-4 | spdx | spdx license identifier cc by nc sa 4 0
1 | cc-by-nc-nd-4 | spdx | spdx license identifier cc by nc nd 4 0
1 | psf-2 | spdx | spdx license identifier psf 2 0
1 | ms-pl | spdx | spdx license identifier ms pl
1 | upl-1 | spdx | spdx license identifier upl 1 0
1 | busl-1-1 | spdx | spdx license identifier busl 1 1
1 | sspl-1 | spdx | spdx license identifier sspl 1 0
1 | spdx-other | spdx | spdx license identifier [a-z0-9]+
1 | cc-by-nc-nd-4 | cc | (?:licensed under )?cc by nc nd 4 0
1 | cc-by-nc-sa-4 | cc | (?:licensed under )?cc by nc sa 4 0
1 | cc-by-nc-4 | cc | (?:licensed under )?cc by nc 4 0
1 | cc-by-nd-4 | cc | (?:licensed under )?cc by nd 4 0
1 | cc-by-sa-4 | cc | (?:licensed under )?cc by sa 4 0
1 | cc-by-4 | cc | (?:licensed under )?cc by 4 0
1 | cc-by-nc-nd-3 | cc | (?:licensed under )?cc by nc nd 3 0
1 | cc-by-nc-sa-3 | cc | (?:licensed under )?cc by nc sa 3 0
1 | cc-by-nc-3 | cc | (?:licensed under )?cc by nc 3 0
1 | cc-by-nd-3 | cc | (?:licensed under )?cc by nd 3 0
1 | cc-by-sa-3 | cc | (?:licensed under )?cc by sa 3 0
1 | cc-by-3 | cc | (?:licensed under )?cc by 3 0
1 | cc-by-nc-nd | cc | cc by nc nd
1 | cc-by-nc-sa | cc | cc by nc sa
1 | cc-by-nd | cc | cc by nd
1 | cc-by-sa | cc | cc by sa
1 | cc0 | cc0 | (?:licensed under )?cc0(?: 1 0)?
1 | cc-by-4 | creativecommons | creativecommons org licenses by 4 0
1 | cc-by-sa-4 | creativecommons | creativecommons org licenses by sa 4 0
1 | cc-by-nc-4 | creativecommons | creativecommons org licenses by nc 4 0
1 | cc-by-nc-sa-4 | creativecommons | creativecommons org licenses by nc sa 4 0
1 | cc-by-nc-nd-4 | creativecommons | creativecommons org licenses by nc nd 4 0
1 | cc0 | creativecommons | creativecommons org publicdomain zero 1 0
1 | cc-pdm | creativecommons | creativecommons org publicdomain mark 1 0
1 | apache-2 | apache | www apache org licenses license 2 0
1 | apache-2 | apache | apache (?:2 0|v2|2) license
1 | mpl-2 | mozilla | mozilla org mpl 2 0
1 | epl-2 | eclipse | eclipse org legal epl 2 0
1 | gpl-3 | gnu | gnu org licenses gpl 3 0
1 | gpl-2 | gnu | gnu org licenses old licenses gpl 2 0
1 | lgpl-3 | gnu | gnu org licenses lgpl 3 0
1 | agpl-3 | gnu | gnu org licenses agpl 3 0
1 | mit | mit | opensource org licenses mit
1 | bsd-3 | bsd | opensource org licenses bsd 3 clause
1 | bsd-2 | bsd | opensource org licenses bsd 2 clause
1 | isc | isc | opensource org licenses isc
1 | gpl-2-or-later | gplv2 | gplv2 or later
1 | gpl-3-or-later | gplv3 | gplv3 or later
1 | gpl-2 | gplv2 | gplv2
1 | gpl-3 | gplv3 | gplv3
1 | lgpl-3 | lgplv3 | lgplv3
1 | lgpl-2-1 | lgplv2 | lgplv2(?: 1)?
1 | agpl-3 | agplv3 | agplv3
1 | gpl-2 | gpl | gpl (?:version |v ?)?2(?: 0)?
1 | gpl-3 | gpl | gpl (?:version |v ?)?3(?: 0)?
1 | lgpl-2-1 | lgpl | lgpl (?:version |v ?)?2 1
1 | lgpl-3 | lgpl | lgpl (?:version |v ?)?3(?: 0)?
1 | agpl-3 | agpl | agpl (?:version |v ?)?3(?: 0)?
1 | mit | mit | under the (?:terms of the )?mit license
1 | mit | mit | license mit
1 | bsd-3 | bsd | license bsd 3 clause
1 | bsd-2 | bsd | license bsd 2 clause
1 | apache-2 | apache | license apache 2(?: 0)?
2 | mit | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
2 | mit | notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2 | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
2 | bsd-3 | endorse | neither the name of [a-z0-9 ]{1,80} nor the names of its contributors may be used to endorse or promote products
2 | bsd-4 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
2 | isc | modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 | zlib | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
2 | apache-2 | compliance | you may not use this file except in compliance with the license
2 | apache-2 | governing | see the license for the specific language governing permissions and limitations under the license
2 | gpl | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
2 | lgpl | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
2 | gpl | warranty | this program is distributed in the hope that it will be useful but without any warranty
2 | gpl | foundation | free software foundation inc 5[19] [a-z0-9 ]{1,60} boston
2 | mpl-2 | mpl | if a copy of the mpl was not distributed with this file
2 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
2 | bsl-1 | accompanying | see accompanying file license 1 0 txt
2 | wtfpl | fuck | you just do what the fuck you want to
2 | ofl-1-1 | font | this font software is licensed under the sil open font license
2 | public-domain | domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
2 | proprietary | reserved | all rights reserved
2 | proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
2 | proprietary | unauthorized | unauthorized copying of this file
2 | no-ai-training | used | may not be used (?:for|to) train(?:ing)? (?:any )?(?:machine learning|artificial intelligence|ai|language) models?
2 | non-commercial | only | (?:for )?non ?commercial (?:use|purposes) only
2 | academic-only | academic | (?:for )?academic (?:use|purposes|research) only
3 | gpl | gnu | gnu general public license
3 | lgpl | lesser | gnu lesser general public license
3 | agpl | affero | gnu affero general public license
3 | gfdl | documentation | gnu free documentation license
3 | apache | apache | apache (?:software )?license
3 | mpl | mozilla | mozilla public license
3 | epl | eclipse | eclipse public license
3 | cddl | distribution | common development and distribution license
3 | artistic | artistic | artistic license
3 | bsd | bsd | bsd (?:style )?license
3 | mit | mit | mit (?:style )?license
3 | cc | creative | creative commons (?:license|attribution)
3 | boost | boost | boost software license
3 | ofl | font | open font license
3 | openrail | openrail | openrail
3 | gpl | gpl | gpl
3 | lgpl | lgpl | lgpl
3 | agpl | agpl | agpl
"""


def rules() -> list[tuple[int, str, str, str]]:
    """(level, label, keyword, regex) in order."""
    out = []
    for line in TABLE.strip().splitlines():
        level, label, keyword, regex = (x.strip() for x in line.split(" | "))
        out.append((int(level), label, keyword, regex))
    return out
