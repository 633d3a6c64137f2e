"""License wordings as templates. The wordings are public texts.

Markup: ``[[ ... ]]`` may be missing; ``{a|b}`` is one of several words;
``{*n}`` stands for up to n words of any kind. Words are compared after
normalisation, so case, punctuation and line breaks do not matter.
"""

#: The four base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: (label, template); each begins with a mandatory word.
TEMPLATES = [
    ("gpl-3.0", "gnu general public {license|licence} [[as published by the free software foundation]] [[either]] [[{v|version}]] {3|v3}"),
    ("gpl-2.0", "gnu general public {license|licence} [[as published by the free software foundation]] [[either]] [[{v|version}]] {2|v2}"),
    ("lgpl", "gnu {lesser|library} general public {license|licence}"),
    ("agpl", "gnu affero general public {license|licence}"),
    ("gpl", "program is free software you can redistribute it and or modify it under the terms of the gnu general public {license|licence}"),
    ("apache-2.0", "{licensed|released|distributed} under [[the terms of]] the apache {license|licence} [[{v|version}]] {2|v2} 0"),
    ("apache-2.0", "apache {license|licence} [[{v|version}]] {2|v2} 0"),
    ("mit", "{licensed|released|distributed} under [[the terms of]] the mit {license|licence}"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the
        software [[the software is provided as is without warranty of any kind express or implied including but not limited
        to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        {*12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising
        from out of or in connection with the software or the use or other dealings in the software]]"""),
    ("isc", """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies"""),
    ("bsd-2-clause", """redistribution and use in source and binary forms with or without modification are permitted provided
        that the following conditions are met [[{*2}]] redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer [[{*2}]] redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution"""),
    ("bsd-3-clause", """neither the name of {*12} nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission"""),
    ("mpl-2.0", "source code form is subject to the terms of the mozilla public license [[{v|version}]] {2|v2} 0"),
    ("cc-by-nc-4.0", "cc by nc [[{nd|sa}]] 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by", "creative commons attribution [[{noncommercial|sharealike|noderivatives}]] [[{noncommercial|sharealike|noderivatives}]] [[{*2}]] {license|licence}"),
    ("cc0", "cc0 1 0 universal"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("spdx", "spdx license identifier"),
    ("mit", "spdx license identifier mit"),
    ("isc", "spdx license identifier isc"),
    ("unlicense", "spdx license identifier unlicense"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("gpl-2.0", "spdx license identifier gpl 2 0"),
    ("gpl-3.0", "spdx license identifier gpl 3 0"),
    ("lgpl", "spdx license identifier lgpl {2|3} {0|1}"),
    ("agpl", "spdx license identifier agpl 3 0"),
    ("mpl-2.0", "spdx license identifier mpl 2 0"),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause"),
    ("gpl-2.0", "gnu gpl [[{v|version}]] {2|v2}"),
    ("gpl-3.0", "gnu gpl [[{v|version}]] {3|v3}"),
    ("mpl-2.0", "mozilla public {license|licence} [[{v|version}]] {2|v2} 0"),
    ("bsd-2-clause", "bsd 2 clause [[{*2}]] {license|licence}"),
    ("bsd-3-clause", "bsd 3 clause [[{*2}]] {license|licence}"),
    ("copyright", "copyright [[c]] {*8} all rights reserved"),
    # whole notices, as they stand at the head of files
    ("gpl-3.0-or-later", """free software you can redistribute it and or modify it under the terms of the gnu general public {license|licence}
        as published by the free software foundation either version 3 of the {license|licence} or at your option any later version
        [[{*4} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public {license|licence} for more details]]"""),
    ("gpl-2.0-or-later", """free software you can redistribute it and or modify it under the terms of the gnu general public {license|licence}
        as published by the free software foundation either version 2 of the {license|licence} or at your option any later version
        [[{*4} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public {license|licence} for more details]]"""),
    ("lgpl-2.1-or-later", """free software you can redistribute it and or modify it under the terms of the gnu {lesser|library} general public
        {license|licence} as published by the free software foundation either version 2 [[1]] of the {license|licence} or at your
        option any later version"""),
    ("lgpl-3.0-or-later", """free software you can redistribute it and or modify it under the terms of the gnu lesser general public
        {license|licence} as published by the free software foundation either version 3 of the {license|licence} or at your
        option any later version"""),
    ("agpl-3.0-or-later", """free software you can redistribute it and or modify it under the terms of the gnu affero general public
        {license|licence} as published by the free software foundation either version 3 of the {license|licence} or at your
        option any later version"""),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use {this|these} {file|files|software} except in
        compliance with the license [[you may obtain a copy of the license at {*8}]] unless required by applicable law or agreed to
        in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any
        kind either express or implied [[see the license for the specific language governing permissions and limitations under the
        license]]"""),
    # heads of the license texts themselves
    ("gpl-text", """gnu [[{lesser|library|affero}]] general public license version {2|3} {*5} copyright [[c]] {*6} free software foundation
        inc {*12} everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not
        allowed"""),
    ("apache-text", """apache license version 2 0 january 2004 [[{*6}]] terms and conditions for use reproduction and distribution"""),
    # the warranty disclaimer of the BSD family
    ("bsd-disclaimer", """this software is provided by {*12} as is and any express or implied warranties including but not limited to the
        implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {*12} be liable
        for any direct indirect incidental special exemplary or consequential damages"""),
]
