"""Licence notices as templates. The wording is the licences' own.

`<<optional>> ... <</optional>>` may be left out, `<<var 0..5>>` stands for so many words; all the rest is mandatory.
Only names, years, headings and list marks vary.
"""

#: What stands for the holder of a copyright inside the wording, and a list mark such as (a), 1. or *.
HOLDER, MARK = "<<var 1..12>>", "<<optional>> <<var 1..1>> <</optional>>"

MIT = """
permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
<<optional>> (the "Software") <</optional>>, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so,
subject to the following conditions: the above copyright notice and this permission notice <<optional>> (including the next paragraph) <</optional>> shall be
included in all copies or substantial portions of the software. the software is provided "as is", without warranty of any kind, express
or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no
event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort
or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software
"""

BSD_HEAD = f"""
redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: {MARK} redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. {MARK} redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""

BSD_NAMES = f"""
{MARK} neither the name of {HOLDER} nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
"""

BSD_TAIL = f"""
this software is provided by {HOLDER} "as is" and any express or implied warranties, including, but not limited to, the implied
warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall {HOLDER} be liable for any direct,
indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or
services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract,
strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the
possibility of such damage
"""

ISC = f"""
permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. the software is provided "as is" and
{HOLDER} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event
shall {HOLDER} be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use,
data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or
performance of this software
"""

APACHE = """
licensed under the apache license, version 2.0 <<optional>> (the "License") <</optional>>; you may not use this file except in
compliance with the license. you may obtain a copy of the license at <<optional>> http <</optional>> <<optional>> https <</optional>>
www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is
distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific
language governing permissions and limitations under the license
"""

UNLICENSE = """
this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means.
"""

MPL = """
this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed
with this file, you can obtain one at <<optional>> http <</optional>> <<optional>> https <</optional>> mozilla.org/mpl/2.0
"""


def gnu_terms(name: str, version: str) -> str:
    """The clause that the notices of GNU licences, and many file headers, have in common."""
    return f"under the terms of the gnu {name} general public license as published by the free software foundation <<optional>> either <</optional>> version {version} of the license, or (at your option) any later version"


#: Notices by label; a label with several is found by any of them.
TEMPLATES = {
    "agpl-3": [gnu_terms("affero", "3")],
    "apache-2": [APACHE, "licensed under <<optional>> the <</optional>> apache license version 2 <<optional>> 0 <</optional>>"],
    "bsd": ["<<optional>> released <</optional>> under the <<optional>> <<var 1..2>> <</optional>> bsd license"],
    "bsd-2": [BSD_HEAD + BSD_TAIL],
    "bsd-3": [BSD_HEAD + BSD_NAMES + BSD_TAIL],
    "cc-by": ["licensed under <<optional>> a <</optional>> <<optional>> creative commons attribution <</optional>> cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": [
        "licensed under <<optional>> a <</optional>> <<optional>> creative commons attribution non commercial <</optional>> cc by nc <<optional>> 4 0 <</optional>>",
        "licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc-by-sa": ["licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law <<var 1..12>> has waived all copyright and related or neighboring rights to <<var 1..12>>"],
    "gpl-2": [gnu_terms("", "2")],
    "gpl-3": [
        "this <<var 1..3>> is licensed under the gnu general public license <<optional>> as published by the free software foundation <</optional>> <<optional>> either <</optional>> version 3",
        gnu_terms("", "3"),
    ],
    "isc": [ISC],
    "lgpl": [gnu_terms("lesser", "2 1"), gnu_terms("lesser", "3")],
    "mit": ["released under the <<optional>> terms of the <</optional>> mit license", MIT],
    "mpl-2": [MPL],
    "unlicense": [UNLICENSE],
}
