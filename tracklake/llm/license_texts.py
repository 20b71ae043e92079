"""Headers, notices and leading paragraphs of public licenses, each with the phrase that must stand in it whole."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Notice:
    """A notice's words in lower case; ``key`` is the phrase in it that must stand whole."""

    label: str
    words: str
    key: str


def _words(text: str) -> str:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return " ".join(kept.split())


def _notice(label: str, key: str, text: str) -> Notice:
    return Notice(label, _words(text), _words(key))


_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}
as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED."""


def _gnu(label: str, name: str, version: str) -> Notice:
    return _notice(label, f"either version {version} of the License", _GNU.format(name=name, version=version))


#: Texts of public licenses.
NOTICES = (
    _notice("apache-2.0", "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0"),
    _notice("apache-2.0", "Apache License, Version 2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you
        may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under
        the License."""),
    _notice("bsd", "Redistribution and use in source and binary forms", """Redistribution and use in source and binary forms,
        with or without modification, are permitted provided that the following conditions are met"""),
    _notice("bsd-2-clause", "provided with the distribution. THIS SOFTWARE IS PROVIDED", f"{_BSD} {_AS_IS}"),
    _notice("bsd-3-clause", "may be used to endorse or promote products derived from this software", f"""{_BSD} Neither the name
        of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission. {_AS_IS}"""),
    _notice("cc-by-4.0", "Creative Commons Attribution 4.0 International License", """This work is licensed under a Creative
        Commons Attribution 4.0 International License"""),
    _notice("cc-by-sa-4.0", "Creative Commons Attribution ShareAlike 4.0 International License", """This work is licensed under
        a Creative Commons Attribution-ShareAlike 4.0 International License"""),
    _notice("cc-by-nc-4.0", "Creative Commons Attribution NonCommercial 4.0 International License", """This work is licensed
        under a Creative Commons Attribution-NonCommercial 4.0 International License"""),
    _notice("cc-by-nc-4.0", "CC BY NC 4.0", "licensed under CC BY-NC 4.0"),
    _notice("cc-by-sa-4.0", "CC BY SA 4.0", "licensed under CC BY-SA 4.0"),
    _notice("cc0-1.0", "waived all copyright and related or neighboring rights", """To the extent possible under law, the author
        has waived all copyright and related or neighboring rights"""),
    _notice("cc0-1.0", "waived all copyright and related or neighboring rights", """To the extent possible under law, the person
        who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"""),
    _gnu("agpl-3.0", "Affero General Public License", "3"),
    _gnu("gpl-2.0", "General Public License", "2"),
    _gnu("gpl-3.0", "General Public License", "3"),
    _gnu("lgpl-2.1", "Lesser General Public License", "2.1"),
    _gnu("lgpl-3.0", "Lesser General Public License", "3"),
    _notice("gpl-2.0", "GNU General Public License version 2", "This work is licensed under the GNU General Public License version 2"),
    _notice("gpl-3.0", "GNU General Public License version 3", "This work is licensed under the GNU General Public License version 3"),
    _notice("lgpl-3.0", "GNU Lesser General Public License version 3", "licensed under the GNU Lesser General Public License version 3"),
    _notice("isc", "with or without fee is hereby granted", """Permission to use, copy, modify, and/or distribute this software for
        any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies."""),
    _notice("isc", "with or without fee is hereby granted", """Permission to use, copy, modify, and/or distribute this software for
        any purpose with or without fee is hereby granted"""),
    _notice("mit", "Permission is hereby granted, free of charge", """Permission is hereby granted, free of charge, to any person
        obtaining a copy of this software and associated documentation files"""),
    _notice("mit", "Permission is hereby granted, free of charge", """Permission is hereby granted, free of charge, to any person
        obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software."""),
    _notice("mit", "MIT License", "Released under the MIT License"),
    _notice("mpl-2.0", "Mozilla Public License, v. 2.0", """This Source Code Form is subject to the terms of the Mozilla Public
        License, v. 2.0"""),
    _notice("mpl-2.0", "Mozilla Public License, v. 2.0", """This Source Code Form is subject to the terms of the Mozilla Public
        License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/."""),
    _notice("epl-2.0", "Eclipse Public License 2.0", """This program and the accompanying materials are made available under the
        terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    _notice("unlicense", "released into the public domain", """This is free and unencumbered software released into the public
        domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    _notice("bsl-1.0", "Boost Software License, Version 1.0", """Distributed under the Boost Software License, Version 1.0. See
        accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"""),
    _notice("zlib", "Altered source versions must be plainly marked as such", """This software is provided 'as-is', without any
        express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. This notice may not be removed or altered from any source distribution."""),
    _notice("artistic-2.0", "Artistic License 2.0", """You may copy and distribute this package under the terms of the Artistic
        License 2.0"""),
)
