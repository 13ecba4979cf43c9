"""Real licence notices that training doesn't use as they stand, by family; near neighbours, denials, licences that aren't listed, other talk."""

import pytest

from quirework.llm import licences

NOTICES = [
    ("AGPL", "This program is licensed under the GNU Affero General Public License version 3 or later."),
    ("AGPL", "it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the License"),
    ("GPL", "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation"),
    ("GPL", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("LGPL", "modify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE.md file"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software)"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License);\nyou may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004"),
    ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."),
    ("CC-BY", "Except where noted, this work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Text is licensed under CC BY-SA 4.0"),
    ("CC-BY-NC", "Slides: licensed under CC BY-NC 4.0"),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("unknown", "This file is not released under the MIT license"),
    ("unknown", "The code is no longer licensed under the Apache License, Version 2.0"),
    ("unknown", "Parts of it aren't covered by nor licensed under the GNU General Public License version 3"),
    ("unknown", "Licensed under the Microsoft Public License"),
    ("unknown", "Licensed under the Python Software Foundation License Version 2"),
    ("unknown", "This software is licensed under the European Union Public Licence v1.2"),
    ("unknown", "Licensed under the PostgreSQL License"),
    ("unknown", "Released under the Ruby License"),
    ("none", "The committee permitted the modification of the garden plan in June."),
    ("none", "MIT researchers found that the general public prefers tea"),
    ("none", "Apache helicopters flew over the free city; the foundation published a version of it"),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(NOTICES)], "doc_id long, text string")
    return {r.doc_id: r for r in licences.scan_licences(docs).collect()}


@pytest.mark.parametrize("k", range(len(NOTICES)), ids=[f"{f}-{k}" for k, (f, _) in enumerate(NOTICES)])
def test_family_of_a_notice(found, k):
    assert found[k].family == NOTICES[k][0]
    assert (found[k].n_licence > 0) == (NOTICES[k][0] not in ("unknown", "none"))
