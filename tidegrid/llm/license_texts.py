"""Words of public licence texts (fixed values): label, mandatory key phrase, text."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
APACHE_GRANT = """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,
worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of,
publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
LGPL_HEADER = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""
AGPL_HEADER = GPL_HEADER.replace("GNU General", "GNU Affero General")
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means."""
BOOST = """Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce,
display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software."""
CC_BY = "This work is licensed under a Creative Commons Attribution 4.0 International License."
CC_BY_SA = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
CC_BY_NC = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
CC_BY_ND = "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."
CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."

#: Texts that are found in place, with words missing, changed or added.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining", MIT),
    ("isc", "permission to use copy modify", ISC),
    ("bsd-2-clause", "redistributions in binary form must reproduce", BSD2),
    ("bsd-3-clause", "endorse or promote products derived from", BSD3),
    ("apache-2.0", "under the apache license version 2 0", APACHE_HEADER),
    ("apache-2.0", "prepare derivative works of publicly display", APACHE_GRANT),
    ("gpl-3.0", "gnu general public license", GPL_HEADER),
    ("lgpl-2.1", "gnu lesser general public license", LGPL_HEADER),
    ("agpl-3.0", "gnu affero general public license", AGPL_HEADER),
    ("mpl-2.0", "mozilla public license", MPL_HEADER),
    ("unlicense", "free and unencumbered software", UNLICENSE),
    ("bsl-1.0", "boost software license", BOOST),
    ("cc-by-4.0", "creative commons attribution 4 0", CC_BY),
    ("cc-by-sa-4.0", "attribution sharealike 4 0", CC_BY_SA),
    ("cc-by-nc-4.0", "attribution noncommercial 4 0", CC_BY_NC),
    ("cc-by-nd-4.0", "attribution noderivatives 4 0", CC_BY_ND),
    ("cc0-1.0", "waived all copyright", CC0),
]
#: Short notices that must stand whole, and their labels.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache-2.0",
    "spdx license identifier gpl 3 0": "gpl-3.0",
    "spdx license identifier bsd 3 clause": "bsd-3-clause",
    "public domain": "public-domain",
}
