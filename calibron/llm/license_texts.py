"""Licence ids and the texts by which licences are declared, for :mod:`calibron.llm.licenses`."""

# Fixed values: (licence id, rank, text). Rank 0 names a licence, 1 is shared by a family, 2 names none.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GNU = (
    "This {thing} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.",
    "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
    "You should have received a copy of the {name} along with this {thing}; if not, write to the Free Software Foundation, or see https://www.gnu.org/licenses/.",
)
_GNU_KINDS = (
    ("AGPL-3.0", "GNU Affero General Public License", "program", "3", "19 November 2007"),
    ("GPL-2.0", "GNU General Public License", "program", "2", "June 1991"),
    ("GPL-3.0", "GNU General Public License", "program", "3", "29 June 2007"),
    ("LGPL-2.0", "GNU Library General Public License", "library", "2", "June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License", "library", "2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "library", "3", "29 June 2007"),
)
_SPDX = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
_CREATIVE = (("CC-BY-4.0", "CC BY 4.0", "Attribution"), ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Attribution-NonCommercial"), ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Attribution-ShareAlike"), ("CC-BY-ND-4.0", "CC BY-ND 4.0", "Attribution-NoDerivatives"))

_PLAIN = (
    ("Apache-2.0", 0, "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 0, _APACHE),
    ("Apache-2.0", 0, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", 0, "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", 0, _BSD_HEAD),
    ("BSD-2-Clause", 0, _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", 0, "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", 0, _BSD_HEAD + _BSD_NAMES),
    ("BSD-3-Clause", 0, _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("BSD-3-Clause", 0, _BSD_NAMES),
    ("BSD-3-Clause", 1, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC0-1.0", 0, "To the extent possible under law, the author has dedicated all copyright to the public domain, CC0 1.0."),
    ("CC0-1.0", 0, "CC0 1.0 Universal"),
    ("EPL-2.0", 0, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", 0, "Released under the ISC License."),
    ("ISC", 0, _ISC_GRANT),
    ("ISC", 0, _ISC_GRANT + _ISC_TAIL),
    ("MIT", 0, "Released under the MIT License."),
    ("MIT", 0, "The MIT License (MIT)"),
    ("MIT", 0, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", 0, _MIT_GRANT),
    ("MIT", 0, _MIT_GRANT + _MIT_NOTICE + _MIT_TAIL),
    ("MPL-2.0", 0, "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", 0, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", 0, "Mozilla Public License Version 2.0"),
    ("Proprietary", 2, "All rights reserved."),
    ("Unlicense", 0, "This is free and unencumbered software released into the public domain."),
    ("Unlicense", 0, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def _templates():
    yield from _PLAIN
    for spdx in _SPDX:
        yield spdx, 0, f"SPDX-License-Identifier: {spdx}"
    for spdx, short, long in _CREATIVE:
        yield spdx, 0, f"Licensed under {short}."
        yield spdx, 0, f"This work is licensed under a Creative Commons {long} 4.0 International License."
    for spdx, name, thing, version, date in _GNU_KINDS:
        yield spdx, 0, f"{name} Version {version}, {date}"
        yield spdx, 0, f"This work is licensed under the {name}, version {version}."
        yield spdx, 0, _GNU[0].format(name=name, thing=thing, version=version)
        yield spdx, 0, " ".join(_GNU).format(name=name, thing=thing, version=version)


TEMPLATES = tuple(_templates())
