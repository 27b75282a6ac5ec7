"""Templates of licence texts, notices and grants.

<<opt>> ... <</opt>> is wording that may be left out, <<var N>> stands for up to N words of any kind.
"""

_WARRANTY = """THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var 1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var 1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var 12>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """<<var 6>> is free software<<opt>>;<</opt>> you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{}"""

TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<</opt>> shall be included in
all copies or substantial portions of the Software. """ + _WARRANTY,
    "ISC": """Permission to use, copy, modify, <<opt>>and<</opt>> <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND <<var 8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL <<var 8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + """<<var 1>> Neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. """ + _BSD_TAIL,
    "Zlib": """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
        granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<var 1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<var 1>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        <<var 1>> This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the License); you may not use <<var 4>> except in compliance with the License. You may obtain a copy of the License at
<<var 10>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0-notice": _GNU.format("General Public License", "; either version 2 of the License<<opt>>, or (at your option) any later version<</opt>>"),
    "GPL-3.0-notice": _GNU.format("General Public License", "<<opt>>, either<</opt>> version 3 of the License<<opt>>, or (at your option) any later version<</opt>>"),
    "LGPL-notice": _GNU.format("<<opt>>Lesser<</opt>> <<opt>>Library<</opt>> General Public License", "; either version <<var 2>> of the License<<opt>>, or (at your option) any later version<</opt>>"),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var 8>>",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.
        We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
        """ + _WARRANTY.replace("SHALL <<var 12>> BE", "SHALL THE AUTHORS BE") + """ <<opt>>For more information, please refer to <<var 8>><</opt>>""",
    "Apache-2.0-grant": "licensed under <<opt>>the<</opt>> Apache <<opt>>Software<</opt>> License <<opt>>Version<</opt>> <<opt>>v<</opt>> 2<<opt>>.0<</opt>>",
    "MIT-grant": "<<opt>>released<</opt>> <<opt>>licensed<</opt>> <<opt>>distributed<</opt>> under <<opt>>the terms of<</opt>> the MIT License",
    "BSD-grant": "<<opt>>released<</opt>> <<opt>>licensed<</opt>> <<opt>>distributed<</opt>> under <<opt>>the terms of<</opt>> <<opt>>the<</opt>> <<opt>>a<</opt>> BSD <<opt>>2 Clause<</opt>> <<opt>>3 Clause<</opt>> <<opt>>style<</opt>> License",
    "GPL-grant": "licensed under <<opt>>the terms of<</opt>> the GNU <<opt>>Lesser<</opt>> <<opt>>Affero<</opt>> General Public License <<opt>>version <<var 2>><</opt>>",
    "CC-grant": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>Creative Commons<</opt>> <<opt>>CC<</opt>> <<opt>>Attribution<</opt>> <<opt>>BY<</opt>> <<opt>>NonCommercial<</opt>> <<opt>>NC<</opt>> <<opt>>ShareAlike<</opt>> <<opt>>SA<</opt>> <<opt>>NoDerivatives<</opt>> <<opt>>ND<</opt>> <<opt>>International License<</opt>> 4.0 <<opt>>International License<</opt>>",
    "SPDX-tag": "SPDX License Identifier <<var 4>>",
    "all-rights-reserved": "All rights reserved",
}
