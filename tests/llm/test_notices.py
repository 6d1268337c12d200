"""Licence scans on real notices that are not among the templates, and on prose; precision and recall by family."""

import collections

from chalkline.llm import licenses

NOTICES = [
    ({"gpl-2.0"}, "This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation."),
    ({"gpl-2.0"}, "This file is part of the tool. It is licensed under the GNU General Public License v2 only."),
    ({"gpl-2.0"}, "This is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License, not later."),
    ({"gpl-2.0"}, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991"),
    ({"gpl-2.0"}, "The kernel module is licensed under the GPLv2."),
    ({"gpl-3.0"}, "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ({"gpl-3.0"}, "# License: GPLv3\nThis script is released under the GPLv3."),
    ({"gpl-3.0"}, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation"),
    ({"gpl-3.0"}, "Distributed under the GNU General Public License v3."),
    ({"lgpl"}, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ({"lgpl"}, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ({"lgpl"}, "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ({"lgpl"}, "You may link to it under the LGPL 2.1 as you like."),
    ({"agpl-3.0"}, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ({"agpl-3.0"}, "The server is available under the AGPLv3 for everyone."),
    ({"apache-2.0"}, "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/"),
    ({"apache-2.0"}, "Copyright 2019 The Authors. Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."),
    ({"apache-2.0"}, "This project is licensed under the Apache 2.0 license, see the file."),
    ({"mit"}, "Copyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish"),
    ({"mit"}, "Use of this library is subject to the MIT license (see LICENSE.txt)."),
    ({"mit", "apache-2.0"}, "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ({"bsd"}, "Copyright (c) 1998. All use subject to this.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. Redistributions of source code must retain the above notice"),
    ({"bsd"}, "The package is distributed under the 3-Clause BSD terms."),
    ({"bsd"}, "It has a BSD license and no warranty."),
    ({"isc"}, "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ({"isc"}, "The code has an ISC license."),
    ({"mpl-2.0"}, "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ({"mpl-2.0"}, "Mozilla Public License Version 2.0\n=================================="),
    ({"epl-2.0"}, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ({"epl-2.0"}, "Eclipse Public License - v 2.0\nTHE ACCOMPANYING PROGRAM IS PROVIDED"),
    ({"zlib"}, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ({"zlib"}, "Part of it comes with the zlib license."),
    ({"bsl-1.0"}, "// Distributed under the Boost Software License, Version 1.0. (See accompanying\n// file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ({"bsl-1.0"}, "Boost Software License - Version 1.0 - August 17th, 2003"),
    ({"artistic-2.0"}, "                       The Artistic License 2.0\n           Copyright (c) 2000-2006"),
    ({"cc0"}, "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work."),
    ({"cc0"}, "The data are under CC0 1.0 Universal."),
    ({"cc-by"}, "Text: this work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy"),
    ({"cc-by-sa"}, "The article is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ({"cc-by-nc"}, "Pictures: licensed under CC BY-NC 4.0."),
    ({"unlicense"}, "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish"),
    ({"unknown"}, "Licensed under the Sunflower License, version 4."),
    ({"unknown"}, "This work is licensed under the Teapot Garden Public License."),
]
PROSE = [
    "A driving license under the age of 18 and the terms of the general agreement.", "The general public license fee for television was raised in June.",
    "He was released under strict terms and the conditions of the court.", "The Apache people lived in the south; version 2.0 of the map shows where.",
    "Under the terms of this lease the tenant may use the garden free of charge.", "The Mozilla festival was open to the public.", "We reserved all the seats and had every right to them.",
    "A copy of the notice shall be included in the minutes of the meeting.", "The eclipse in June was published by the paper in a later version.", "MIT opened a new laboratory for artistic work.",
    "The boost to software exports came in August, on the 17th.", "The lesser of two evils is still an evil, the general said.", "Redistribution of land in the provinces was permitted in 1991.",
    "Permission to build was granted to any person living in the parish.", "The foundation published version three of the plan, or any later one.", "The creative commons room is on the second floor.",
    "The driver must obtain a license from the office in compliance with the law.", "She holds a license to practise medicine in the state.", "The library is free to the public, with or without a card.",
]


def test_notices_and_prose(spark):
    texts = [t for _, t in NOTICES] + PROSE
    want = [f for f, _ in NOTICES] + [set() for _ in PROSE]
    found = collections.defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found[r.doc_id].add(r.family)
    right, given, asked = collections.Counter(), collections.Counter(), collections.Counter()
    for k, families in enumerate(want):
        asked.update(families)
        given.update(found[k])
        right.update(families & found[k])
    wrong = [(texts[k][:70], want[k], found[k]) for k in range(len(texts)) if want[k] != found[k]]
    for family in asked | given:
        assert right[family] >= 0.95 * asked[family] and right[family] >= 0.95 * given[family], (family, wrong)
    assert not any(found[len(NOTICES) + k] for k in range(len(PROSE))), wrong


def test_repeated_rows_give_their_findings_once_each(spark):
    rows = [(1, "Licensed under the MIT license.", "x")] * 3 + [(None, "Licensed under the MIT license.", "y")] * 2 + [(1, None, "z"), (2, "MIT license and ISC license", "w")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, family string")).collect()
    assert collections.Counter((r.doc_id, r.family) for r in got) == {(1, "mit"): 3, (None, "mit"): 2, (2, "mit"): 1, (2, "isc"): 1}
