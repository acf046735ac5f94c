"""Texts by which public licenses are granted or named.

Fixed values: the wordings that the licenses themselves prescribe, in full where they are short and as the notice
for source files where they are long.  Short notices are made from a license's names by rule.
"""

from __future__ import annotations

_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THREE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_LATER = "of the License, or (at your option) any later version."

#: License -> its texts.
TEXTS = {
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software""",
    ],
    "MIT-0": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE
        IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    ],
    "0BSD": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""],
    "BSD-unspecified": [_BSD_OPENING],
    "BSD-2-Clause": [f"{_BSD_OPENING}: 1. {_BSD_ONE} 2. {_BSD_TWO} {_WARRANTY_BSD}", f"{_BSD_OPENING}: {_BSD_ONE} {_BSD_TWO} {_WARRANTY_BSD}"],
    "BSD-3-Clause": [f"{_BSD_OPENING}: 1. {_BSD_ONE} 2. {_BSD_TWO} 3. {_BSD_THREE} {_WARRANTY_BSD}", f"{_BSD_OPENING}: {_BSD_ONE} {_BSD_TWO} {_BSD_THREE} {_WARRANTY_BSD}", _BSD_THREE],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied.""",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0""",
    ],
    "GPL-2.0": [
        f"""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 {_LATER}""",
        "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "GPL-3.0": [
        f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 {_LATER}""",
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL-2.1": [
        f"""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 {_LATER}""",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ],
    "LGPL-3.0": [
        f"""This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation, either version 3 {_LATER}""",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "AGPL-3.0": [
        f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 {_LATER}""",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "subject to the terms of the Mozilla Public License, v. 2.0",
    ],
    "EPL-2.0": ["""This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/"""],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
        "This is free and unencumbered software released into the public domain.",
    ],
    "CC0-1.0": [
        """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the
        public domain worldwide. This software is distributed without any warranty.""",
        "has waived all copyright and related or neighboring rights to this work",
        "Creative Commons CC0 1.0 Universal Public Domain Dedication",
    ],
}

#: License -> the names that short notices use.
NAMES = {
    "MIT": ["the MIT License"],
    "ISC": ["the ISC License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL version 2", "the GPLv2 License"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL version 3", "the GPLv3 License"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL version 3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"],
    "BSL-1.0": ["the Boost Software License 1.0", "the Boost Software License, version 1.0"],
    "Zlib": ["the zlib License"],
}
_VERBS = ("licensed under", "released under", "distributed under", "available under", "published under", "provided under", "covered by", "under the terms of")
#: The parts of a Creative Commons license: code -> words of its name.
_CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def templates() -> dict[str, list[str]]:
    """All texts by license: the fixed ones, and short notices of five words or more."""
    out = {name: list(texts) for name, texts in TEXTS.items()}
    for name, own in NAMES.items():
        out[name] += [f"{verb} {title}" for title in own for verb in _VERBS if len(f"{verb} {title}".split()) >= 5]
    for code, words in _CREATIVE.items():
        titles = [f"CC {code} 4.0", f"a CC {code} 4.0 license", f"the CC {code} 4.0 license", f"a Creative Commons {words} 4.0 International License", f"the Creative Commons {words} 4.0 International License", f"Creative Commons {words} 4.0"]
        out[f"CC-{code}-4.0"] = [f"{verb} {title}" for title in titles for verb in _VERBS[:6]]
    return out
