"""Licence texts and notices, as published, that ``licenses`` knows by default."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""

_ZERO_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted."""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""

_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Identifier, title that may stand above the text, text.
LICENSES = [
    ("MIT", "MIT License", _MIT_GRANT),
    ("MIT", "The MIT License (MIT)", _MIT_GRANT),
    ("ISC", "ISC License", f"{_ISC_GRANT}\n\n{_ISC_WARRANTY}"),
    ("0BSD", "Zero-Clause BSD", f"{_ZERO_GRANT}\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", "BSD 2-Clause License", f"{_BSD_TERMS}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", "BSD 3-Clause License", f"{_BSD_TERMS}\n\n{_BSD_NAMES}\n\n{_BSD_WARRANTY}"),
    ("Zlib", "zlib License", _ZLIB),
]

#: Identifier, notice that stands for the whole text.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

#: Identifier and digest of all words of long licences in their published texts, their own notices and appendices included.
WORDINGS = [
    ("Apache-2.0", "ed4d0ee78cc123e955c44f930ce77930"),
    ("Artistic-1.0-Perl", "74f1e3cda1403e07ae43420f9f67955a"),
    ("CC0-1.0", "92858801dcc6eb7f6eac73e3a9292b99"),
    ("GFDL-1.2", "5e9e424acea63aff00acfbc560e4eede"),
    ("GFDL-1.3", "d783948c24cf04870467d112fc687824"),
    ("GPL-1.0", "29a20b01260424ac87e15ba1f732eed5"),
    ("GPL-2.0", "d98147d9641afe1b51fd43c885be8da6"),
    ("GPL-3.0", "10b78d4f8fa6382782a227289d64d833"),
    ("LGPL-2.0", "43b4b92842b92066ace36153159f25bc"),
    ("LGPL-2.1", "9ac02a794773f6176c47c73acadf07dd"),
    ("LGPL-3.0", "b6e6f6f56aeefd764d26bc5c57a4f81b"),
    ("MPL-1.1", "63b928d70cda219c2a5f3e4585145dd8"),
    ("MPL-2.0", "91cb597a6809f99333cad35f0bc6f107"),
]
#: Words, of which each of those texts holds one in lower case.
WORDING_MARKS = ("gnu", "apache", "mozilla", "artistic", "cc0")

#: Spellings that count as one, as words of the canonical text.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("cancelled", "canceled"), ("centre", "center"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("merchantibility", "merchantability"), ("modelling", "modeling"), ("modernise", "modernize"), ("noncommercial", "non  commercial"),
    ("organisation", "organization"), ("organisations", "organizations"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]
