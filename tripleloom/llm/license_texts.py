"""License wording as template markup: `<<optional>>...<</optional>>` may be missing, `<<var max=N>>` stands for up to N words.

The wording is that of the licenses themselves and fixed; case and punctuation don't matter.
"""

WARRANTY = "without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."

MIT = f"""
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<optional>>(including the next paragraph)<</optional>> shall be included in all copies or substantial
portions of the Software.
The Software is provided "as is", {WARRANTY} In no event shall the <<var max=12>> be liable for any claim, damages or other liability, whether in an action of
contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.
"""

MIT_0 = f"""
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so.
The Software is provided "as is", {WARRANTY}
"""

BSD_CONDITIONS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<optional>>1.<</optional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<optional>>2.<</optional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
"""

BSD_NAMES = """
<<optional>>3.<</optional>> Neither the name of <<var max=12>> nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
"""

BSD_DISCLAIMER = """
This software is provided by <<var max=12>> "as is" and any express or implied warranties, including, but not limited to, the implied warranties of
merchantability and fitness for a particular purpose are disclaimed. In no event shall <<var max=12>> be liable for any direct, indirect, incidental,
special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or
business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise)
arising in any way out of the use of this software, even if advised of the possibility of such damage.
"""

ISC = """
Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.
The software is provided "as is" and <<var max=4>> disclaims all warranties with regard to this software including all implied warranties of merchantability
and fitness. In no event shall <<var max=4>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from
loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or
performance of this software.
"""

ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions:
"""

UNLICENSE = """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
"""

BOOST = """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
permit third-parties to whom the Software is furnished to do so, all subject to the following:
"""

APACHE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var max=3>> except in compliance with the License. You may obtain a copy of
the License at <<optional>>http<<optional>>s<</optional>>://www.apache.org/licenses/LICENSE-2.0<</optional>> Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""

MPL = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at
"""


def _gnu(kind: str, version: str) -> str:
    """The notice of a GNU license, of that version or any later."""
    return f"""
    <<var max=4>> is free software<<optional>>:<</optional>> you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as
    published by the Free Software Foundation<<optional>>,<</optional>> <<optional>>either<</optional>> version {version} of the License <<optional>>, or (at
    your option) any later version<</optional>>
    """


CC0 = """
The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under
copyright law
"""


def _cc(kind: str) -> str:
    """The sentence of a Creative Commons deed."""
    return f"licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> Creative Commons Attribution {kind} <<optional>>4.0<</optional>> <<optional>>3.0<</optional>> <<var max=2>> License"


#: label, markup
TEMPLATES = (
    ("mit", MIT),
    ("mit", "<<var max=3>> released under the <<optional>>terms of the<</optional>> MIT license"),
    ("mit", "licensed under the <<optional>>terms of the<</optional>> MIT license"),
    ("mit-0", MIT_0),
    ("bsd-2-clause", BSD_CONDITIONS + BSD_DISCLAIMER),
    ("bsd-3-clause", BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", ISC),
    ("zlib", ZLIB),
    ("unlicense", UNLICENSE),
    ("bsl-1.0", BOOST),
    ("apache-2.0", APACHE),
    ("apache-2.0", "licensed under <<optional>>the terms of<</optional>> the Apache License <<optional>>Version<</optional>> 2.0"),
    ("mpl-2.0", MPL),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License <<optional>>v<</optional>> <<optional>>version<</optional>> 2.0"),
    ("gpl-2.0", _gnu("", "2")),
    ("gpl-3.0", _gnu("", "3")),
    ("lgpl-2.1", _gnu("Lesser", "2.1")),
    ("lgpl-3.0", _gnu("Lesser", "3")),
    ("agpl-3.0", _gnu("Affero", "3")),
    ("gpl-any", "licensed under the <<optional>>terms of the<</optional>> GNU <<optional>>Lesser<</optional>> <<optional>>Affero<</optional>> General Public License"),
    ("gpl-3.0", "GNU General Public License <<optional>>as published by the Free Software Foundation<</optional>> <<optional>>either<</optional>> version 3"),
    ("gpl-2.0", "GNU General Public License <<optional>>as published by the Free Software Foundation<</optional>> <<optional>>either<</optional>> version 2"),
    ("cc0", CC0),
    ("cc-by-nc", "licensed under <<optional>>a Creative Commons<</optional>> CC BY-NC"),
    ("cc-by-sa", "licensed under <<optional>>a Creative Commons<</optional>> CC BY-SA"),
    ("cc-by-license", "licensed under <<optional>>a Creative Commons<</optional>> CC BY"),
    ("cc-by-license", _cc("")),
    ("cc-by-sa", _cc("ShareAlike")),
    ("cc-by-nc", _cc("NonCommercial")),
    ("copyright-notice", "copyright <<optional>>c<</optional>> <<var max=6>> all rights reserved"),
)
