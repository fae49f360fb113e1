"""Public license texts and standard notices, by label, with the phrases without which they are none."""

AS_IS_HOLDERS = """the software is provided as is without warranty of any kind express or implied including but not limited to the
warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright
holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from
out of or in connection with the software or the use or other dealings in the software"""

BSD_START = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and
the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the
following disclaimer in the documentation and or other materials provided with the distribution"""

BSD_END = """this software is provided by the copyright holders and contributors as is and any express or implied warranties
including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in
no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential
damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""

GNU = """this program is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as
published by the free software foundation either version {version} of the license or at your option any later version this
program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
merchantability or fitness for a particular purpose see the gnu {kind} public license for more details you should have received
a copy of the gnu {kind} public license along with this program"""

TEMPLATES = {
    "mit": (
        ("released under the mit license", ("mit license",)),
        ("""permission is hereby granted free of charge to any person obtaining a copy of this software and associated
         documentation files the software to deal in the software without restriction including without limitation the rights to use
         copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
         software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall
         be included in all copies or substantial portions of the software """ + AS_IS_HOLDERS,
         ("hereby granted free of charge", "without restriction")),
        ("""permission is hereby granted free of charge to any person obtaining a copy of this software and associated
         documentation files the software to deal in the software without restriction""",
         ("hereby granted free of charge", "without restriction")),
    ),
    "isc": (
        ("""permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
         provided that the above copyright notice and this permission notice appear in all copies the software is provided as is
         and the author disclaims all warranties with regard to this software including all implied warranties of merchantability
         and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
         whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
         arising out of or in connection with the use or performance of this software""",
         ("with or without fee", "appear in all copies")),
        ("released under the isc license", ("isc license",)),
    ),
    "0bsd": (
        ("""permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the
         software is provided as is and the author disclaims all warranties with regard to this software""",
         ("hereby granted the software is provided",)),
    ),
    "bsd": (
        (BSD_START + " " + BSD_END, ("redistribution and use", "source and binary forms")),
        ("""redistribution and use in source and binary forms with or without modification are permitted provided that the
         following conditions are met""", ("redistribution and use", "source and binary forms")),
        ("released under the bsd license", ("bsd license",)),
    ),
    "bsd-3": (
        (BSD_START + """ neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
         products derived from this software without specific prior written permission """ + BSD_END,
         ("source and binary forms", "endorse or promote products")),
    ),
    "zlib": (
        ("""this software is provided as is without any express or implied warranty in no event will the authors be held liable for
         any damages arising from the use of this software permission is granted to anyone to use this software for any purpose
         including commercial applications and to alter it and redistribute it freely subject to the following restrictions the
         origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this
         software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source
         versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be
         removed or altered from any source distribution""",
         ("must not be misrepresented", "altered from any source distribution")),
    ),
    "boost": (
        ("""permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
         accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit
         the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished
         to do so all subject to the following the copyright notices in the software and this entire statement including the above
         license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part
         and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable
         object code generated by a source language processor""",
         ("any person or organization", "machine executable object code")),
        ("distributed under the boost software license version 1 0", ("boost software license",)),
    ),
    "unlicense": (
        ("""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
         sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
         commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate
         any and all copyright interest in the software to the public domain""", ("free and unencumbered software",)),
    ),
    "wtfpl": (
        ("""do what the fuck you want to public license terms and conditions for copying distribution and modification you just do
         what the fuck you want to""", ("what the fuck you want to",)),
    ),
    "postgresql": (
        ("""permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a
         written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two
         paragraphs appear in all copies""", ("without a written agreement", "following two paragraphs")),
    ),
    "ncsa": (
        ("""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
         files the software to deal with the software without restriction including without limitation the rights to use copy modify
         merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished
         to do so subject to the following conditions redistributions of source code must retain the above copyright notice this list of
         conditions and the following disclaimers""", ("deal with the software without restriction", "following disclaimers")),
    ),
    "apache-2": (
        ("licensed under the apache license version 2 0", ("apache license",)),
        ("""licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
         you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to
         in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
         either express or implied see the license for the specific language governing permissions and limitations under the license""",
         ("apache license", "except in compliance")),
    ),
    "gpl": (
        ("this work is licensed under the gnu general public license version 3", ("general public license",)),
        (GNU.format(kind="general", version="3"), ("free software", "gnu general public license", "either version 3")),
        (GNU.format(kind="general", version="2"), ("free software", "gnu general public license", "either version 2")),
    ),
    "lgpl": (
        (GNU.format(kind="lesser general", version="2 1"), ("free software", "lesser general public license")),
        ("licensed under the gnu lesser general public license version 3", ("lesser general public license",)),
    ),
    "agpl": (
        (GNU.format(kind="affero general", version="3"), ("free software", "affero general public license")),
        ("licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ),
    "mpl-2": (
        ("""this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
         with this file you can obtain one at http mozilla org mpl 2 0""", ("mozilla public license",)),
        ("licensed under the mozilla public license version 2 0", ("mozilla public license",)),
    ),
    "epl-2": (
        ("""this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is
         available at""", ("eclipse public license",)),
    ),
    "cddl": (
        ("""the contents of this file are subject to the terms of the common development and distribution license the license you may
         not use this file except in compliance with the license""", ("common development and distribution license",)),
    ),
    "eupl": (
        ("""licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the
         eupl the licence you may not use this work except in compliance with the licence""", ("the eupl", "european commission")),
    ),
    "artistic-2": (
        ("""this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0""",
         ("artistic license",)),
    ),
    "ofl": (
        ("""this font software is licensed under the sil open font license version 1 1 this license is copied below and is also
         available with a faq at""", ("open font license",)),
    ),
    "cc0": (
        ("""to the extent possible under law the author has waived all copyright and related or neighboring rights to this work""",
         ("waived all copyright",)),
        ("released under the creative commons cc0 1 0 universal public domain dedication", ("public domain dedication",)),
    ),
    "cc-by": (
        ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ),
    "cc-by-sa": (
        ("this work is licensed under a creative commons attribution sharealike 4 0 international license",
         ("creative commons", "attribution sharealike")),
        ("licensed under cc by sa 4 0", ("cc by sa",)),
    ),
    "cc-by-nc": (
        ("licensed under cc by nc 4 0", ("cc by nc",)),
        ("this work is licensed under a creative commons attribution noncommercial 4 0 international license",
         ("creative commons", "noncommercial")),
    ),
    "cc-by-nd": (
        ("this work is licensed under a creative commons attribution noderivatives 4 0 international license",
         ("creative commons", "noderivatives")),
        ("licensed under cc by nd 4 0", ("cc by nd",)),
    ),
}
