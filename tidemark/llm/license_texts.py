"""Short licences as texts, long ones as canonical digests, and the wordings of licence notices."""

from __future__ import annotations

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: (licence, text); copyright lines are left out, as the canonical form drops them.
TEXTS: list[tuple[str, str]] = [
    ("MIT", f"MIT License\n{_MIT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_WARRANTY}"),
    ("MIT", f"{_MIT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n{_MIT}.\n{_WARRANTY}"),
    ("ISC", f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC}.\n{_ISC_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD}{_BSD_END}"),
    ("BSD-2-Clause", f"{_BSD}{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD}{_BSD_3}{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD}{_BSD_3}{_BSD_END}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

#: (licence, SHA-256 of the canonical form).
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "6e233e822e2aeb38236d65254669359af74a6a83e74acecf88e9ad9602fe6276"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "71c532bbed0a27a310a347e640090ae15d10b12867dbb01eabbb4a0c3a81e3bf"),
    ("GFDL-1.3", "fec9cc5e5c1e9857dbb9bbf6f5507fab30f7b21ed301a6d1b150b2790a06992b"),
    ("GPL-1.0", "160c74cee4013ca5418bd3648b4e205c6e0d38b5507407deffe7f5a5a9f31b60"),
    ("GPL-2.0", "652aa03b0e13f5393ad2f49e9e203ef509d88747d904ab36b7ff23bc92c4a6f6"),
    ("GPL-3.0", "2184085f51fbff21c903f7f7267c73958cfb6f7139b694149317eab2940d948d"),
    ("LGPL-2.0", "5df277a264b0db9f656dea052fa76d8fbe46620768b01b8f09f76ef719771d95"),
    ("LGPL-2.1", "659bfcbba21e743ae02dd4d5518f6bf275275dfe701b5ff9c9b8d21e24d85589"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "ec2505010c58b36183acaffa047c9588d0c5f52ad0f82d1788e779cac50f2c0e"),
    ("MPL-2.0", "0c0e48da106b389986ac108e2ee0ad1c64670b63f2fbe0703edcbaedb049daa8"),
]

_NAMES = {
    "MIT": ["MIT", "MIT License", "the MIT License", "the terms of the MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "the Apache 2.0 License", "Apache 2.0", "Apache-2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2", "the GNU GPL v2", "GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3", "the GNU General Public License v3.0", "the GNU GPL v3", "GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL v3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPL v3", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "BSD-3-Clause"],
    "BSD": ["the BSD License", "a BSD-style license", "BSD"],
    "ISC": ["the ISC License", "ISC"],
    "Unlicense": ["the Unlicense", "Unlicense"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "EPL-2.0"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0-1.0", "the Creative Commons CC0 1.0 Universal License"],
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_ENDS = {"4.0": "International", "3.0": "Unported"}
for _k, _v in _CC.items():
    for _n, _e in _ENDS.items():
        _long = f"Creative Commons {_v} {_n}"
        _NAMES[f"CC-{_k}-{_n}"] = [f"CC {_k} {_n}", f"CC-{_k}-{_n}", f"a {_long} License", f"a {_long} {_e} License", f"the {_long} License", f"the {_long} {_e} License"]
_LEADS = ["{}", "{}", "Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.", "License: {}", "SPDX-License-Identifier: {}"]
_LEADS += [f"{what} {verb} under {{}}." for what in ("This work is", "This project is", "This software is", "This file is", "This code is", "This program is", "This article is", "This document is", "The content is") for verb in ("licensed", "released", "distributed", "available")]

#: (licence, notice): a text, or a line of one, that names a licence without being it. A bare name is none.
NOTICES: list[tuple[str, str]] = [(k, lead.format(n)) for k, names in _NAMES.items() for n in names for lead in _LEADS[2:]]
