"""Texts of licences that whole files and blocks of lines are compared with.

Short licences stand in full, of long ones the sentences that mark them; then titles and usual file headers.
"""

_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
)

TEXTS = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "License shall mean the terms and conditions for use, reproduction, and distribution. Licensor shall mean the copyright owner or entity "
        "authorized by the copyright owner that is granting the License. Legal Entity shall mean the union of the acting entity and all other "
        "entities that control, are controlled by, or are under common control with that entity. You or Your shall mean an individual or Legal "
        "Entity exercising permissions granted by this License. Work shall mean the work of authorship, whether in Source or Object form, made "
        "available under the License. Derivative Works shall mean any work that is based on or derived from the Work. Contribution shall mean any "
        "work of authorship intentionally submitted to Licensor for inclusion in the Work by the copyright owner. Contributor shall mean Licensor "
        "and any individual or Legal Entity on behalf of whom a Contribution has been received by Licensor and subsequently incorporated within "
        "the Work. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, "
        "publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form. You must retain, in the Source "
        "form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the "
        "Work. If the Work includes a NOTICE text file as part of its distribution, then any Derivative Works that You distribute must include a "
        "readable copy of the attribution notices contained within such NOTICE file.",
    ),
    ("BSD-2-Clause", _REDISTRIBUTION + _DISCLAIMER),
    ("BSD-3-Clause", _REDISTRIBUTION + _ENDORSEMENT + _DISCLAIMER),
    ("CC0-1.0", "CC0 1.0 Universal"),
    (
        "CC0-1.0",
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights upon the creator and "
        "subsequent owner of an original work of authorship and/or a database. To the greatest extent permitted by, but not in contravention of, "
        "applicable law, Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of "
        "Affirmer Copyright and Related Rights and associated claims and causes of action in the Work. Affirmer makes the Waiver for the benefit "
        "of each member of the public at large and to the detriment of Affirmer heirs and successors. Should any part of the Waiver for any reason "
        "be judged legally invalid or ineffective under applicable law, then the Waiver shall be preserved to the maximum extent permitted.",
    ),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", _HEADER.format(n=2)),
    (
        "GPL-2.0",
        "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed "
        "under the terms of this General Public License. The Program refers to any such program or work, and a work based on the Program means "
        "either the Program or any derivative work under copyright law. You may copy and distribute verbatim copies of the Program source code as "
        "you receive it, in any medium. You may modify your copy or copies of the Program or any portion of it, thus forming a work based on the "
        "Program, and copy and distribute such modifications or work. You may copy and distribute the Program in object code or executable form "
        "provided that you accompany it with the complete corresponding machine-readable source code, which must be distributed under the terms "
        "of this License. Each time you redistribute the Program, the recipient automatically receives a license from the original licensor to "
        "copy, distribute or modify the Program subject to these terms and conditions. Activities other than copying, distribution and "
        "modification are not covered by this License. When we speak of free software, we are referring to freedom, not price.",
    ),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", _HEADER.format(n=3)),
    (
        "GPL-3.0",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The Program refers to any copyrightable "
        "work licensed under this License. A covered work means either the unmodified Program or a work based on the Program. To propagate a work "
        "means to do anything with it that, without permission, would make you liable for infringement under applicable copyright law. To convey a "
        "work means any kind of propagation that enables other parties to make or receive copies. The Corresponding Source for a work in object "
        "code form means all the source code needed to generate, install, and run the object code and to modify the work. You may convey a covered "
        "work in object code form, provided that you also convey the machine-readable Corresponding Source under the terms of this License. "
        "Installation Information for a User Product means any methods required to install and execute modified versions of a covered work. "
        "Each contributor grants you a patent license under the essential patent claims to make, use, sell, and propagate the contents of its "
        "contributor version. You may not impose any further restrictions on the exercise of the rights granted under this License. If you convey "
        "a covered work, you must license the entire work, as a whole, under this License to anyone who comes into possession of a copy.",
    ),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    (
        "LGPL-3.0",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public "
        "License. The Library refers to a covered work governed by this License, other than an Application or a Combined Work. An Application is "
        "any work that makes use of an interface provided by the Library. A Combined Work is a work produced by combining or linking an "
        "Application with the Library. The particular version of the Library with which the Combined Work was made is also called the Linked "
        "Version. You may convey a Combined Work under terms of your choice that do not restrict modification of the portions of the Library "
        "contained in the Combined Work and reverse engineering for debugging such modifications.",
    ),
    ("MIT", "MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "MPL-2.0",
        "Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. Contribution "
        "means Covered Software of a particular Contributor. Covered Software means Source Code Form to which the initial Contributor has attached "
        "the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form. Larger Work means a "
        "work that combines Covered Software with other material, in a separate file or files. Each Contributor hereby grants You a world-wide, "
        "royalty-free, non-exclusive license under patent claims of such Contributor. All distribution of Covered Software in Source Code Form, "
        "including any Modifications that You create or to which You contribute, must be under the terms of this License. If You distribute "
        "Covered Software in Executable Form then such Covered Software must also be made available in Source Code Form. Incompatible With "
        "Secondary Licenses means that the initial Contributor has attached the notice described in Exhibit B.",
    ),
]
