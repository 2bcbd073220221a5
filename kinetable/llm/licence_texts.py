"""Paragraphs of public licences in words, each with the label and the phrase that has to stand word for word."""

from __future__ import annotations

#: (label, key phrase, paragraph)
PARAGRAPHS = (
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing",
     "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the rights to use copy modify merge publish distribute sublicense",
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "this permission notice shall be included in all copies",
     "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind",
     "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "the mit license", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice",
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce",
     "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "may be used to endorse or promote products derived from this software",
     "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "as is and any express or implied warranties",
     "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "modify and or distribute this software for any purpose",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the author disclaims all warranties with regard to this software",
     "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("gpl", "under the terms of the gnu general public license",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-notice", "in the hope that it will be useful but without any warranty",
     "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "lesser general public license", "gnu lesser general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license",
     "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero general public license", "gnu affero general public license"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file",
     "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("boost", "boost software license", "boost software license version 1 0"),
    ("boost", "to any person or organization obtaining a copy of the software and accompanying documentation",
     "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("zlib", "as is without any express or implied warranty",
     "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software must not be misrepresented",
     "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such",
     "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered software released into the public domain",
     "this is free and unencumbered software released into the public domain"),
    ("unlicense", "free to copy modify publish use compile sell or distribute this software",
     "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "permitted to copy and distribute verbatim or modified copies",
     "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc-by-4.0", "creative commons attribution 4 0 international",
     "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "commons attribution sharealike", "creative commons attribution sharealike"),
    ("cc0", "cc0 1 0", "cc0 1 0 universal"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
)
