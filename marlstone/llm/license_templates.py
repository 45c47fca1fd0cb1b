"""License wordings in template markup, by label.

`<<beginOptional>> ... <<endOptional>>` may be left out; `<<var;name="n";original="o";match="m">>` stands for replaceable
words: match is `.{a,b}`, any a to b words, or wordings between bars. Everything else is mandatory. Upper case and
punctuation do not count. A line that has mandatory words is a section: the score of a text grows with the sections read.
"""

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_GRANT = '<<var;name="verb";original="licensed";match="licensed|released|distributed|published|available|provided|made available|is">>'
_UNDER = 'under <<beginOptional>>the <<var;name="terms";original="terms of the";match="terms of the|terms and conditions of the|terms of">><<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>>'

#: Public license texts and notices, label and template.
TEMPLATES = [
    # ------------------------------------------------------------ notices of one sentence
    ("mit", f"{_GRANT} {_UNDER} mit license"),
    ("apache-2.0", f"{_GRANT} {_UNDER} apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("gpl-3.0", f"{_GRANT} {_UNDER} gnu general public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> <<var;name=\"number\";original=\"3\";match=\"3|v3\">>\n"),
    ("gpl-2.0", f"{_GRANT} {_UNDER} gnu general public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> <<var;name=\"number\";original=\"2\";match=\"2|v2\">>\n"),
    ("cc-by-nc-4.0", f'{_GRANT} {_UNDER} <<var;name="deed";original="CC BY-NC";match="cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial">> 4 0'),
    ("cc-by-4.0", f'{_GRANT} {_UNDER} <<var;name="deed";original="CC BY";match="cc by|creative commons attribution">> 4 0'),
    # ------------------------------------------------------------ whole texts
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
<<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED <<var;name="asis";original="AS IS";match="as is|“as is”">>, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL <<var;name="holder";original="the authors or copyright holders";match=".{1,20}">>
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED <<var;name="asis";original="AS IS";match="as is|“as is”">> AND <<var;name="holder";original="the author";match=".{1,20}">>
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    *[
        (
            label,
            f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>><<var;name="bullet";original="1.";match="1|a">><<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>><<var;name="bullet";original="2.";match="2|b">><<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY <<var;name="holder";original="the copyright holders and contributors";match=".{{1,20}}">>
<<var;name="asis";original="AS IS";match="as is|“as is”">> AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        )
        for label, third in (
            ("bsd-2-clause", ""),
            (
                "bsd-3-clause",
                """<<beginOptional>><<var;name="bullet";original="3.";match="3|c">><<endOptional>> Neither the name of <<var;name="organization";original="the copyright holder";match=".{1,20}">>
nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
            ),
        )
    ],
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>;
you may not use <<var;name="what";original="this file";match="this file|these files|this work|this project">> except in compliance with the License.
You may obtain a copy of the License at <<var;name="address";original="http://www.apache.org/licenses/LICENSE-2.0";match=".{1,12}">>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an <<var;name="asis";original="AS IS";match="as is|“as is”">> BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    ),
    *[
        (
            f"{label}-{number}.0-or-later",
            f"""is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it
under the terms of the GNU {name} General Public License as published by the Free Software Foundation;
either version {number} of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version.""",
        )
        for label, name in (("gpl", ""), ("lgpl", "Lesser"), ("agpl", "Affero"))
        for number in (2, 3)
    ],
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, <<beginOptional>>You can obtain one at <<var;name="address";original="https://mozilla.org/MPL/2.0/";match=".{1,10}">><<endOptional>>""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    (
        "zlib",
        """This software is provided <<var;name="asis";original="as-is";match="as is|‘as is’">>, without any express or implied warranty.
In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions:""",
    ),
]
