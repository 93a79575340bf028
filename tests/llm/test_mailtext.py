from rfloom.llm.mailtext import read_message, strip_markup


def test_plain_and_subject():
    assert read_message("Subject: =?utf-8?B?R3LDvMOfZQ==?=\r\n\r\nHallo\r\n") == ("Grüße", ["Hallo\n"])
    assert read_message(None) == ("", []) == read_message("")
    assert read_message("no headers at all") == ("", ["no headers at all"])


def test_markup():
    assert strip_markup("<p>a<b>b</b>c</p><script>x</script>&amp;").split() == ["abc", "&"]


def test_nested_and_broken_multiparts():
    inner = '--i\nContent-Type: text/html\n\n<i>two</i>\n--i--\n'
    message = f'Content-Type: multipart/mixed;\n boundary="o"\n\npreamble\n--o\n\none\n--o\nContent-Type: multipart/alternative; boundary=i\n\n{inner}\n--o\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA\n'
    assert [p.strip() for p in read_message(message)[1]] == ["one", "two"]
    assert read_message("Content-Type: multipart/mixed; boundary=x\n\nnothing here")[1] == ["nothing here"]
    assert read_message("Content-Type: multipart/mixed\n\nno boundary")[1] == ["no boundary"]


def test_codings_and_wrong_character_sets():
    assert read_message("Content-Transfer-Encoding: quoted-printable\n\nna=C3=AFve =\nline")[1] == ["naïve line"]
    assert read_message("Content-Type: text/plain; charset=us-ascii\nContent-Transfer-Encoding: base64\n\n4Q==")[1] == ["á"]
    assert read_message("Content-Transfer-Encoding: base64\n\n!!!")[1] == [""]
    assert read_message("Subject: a\n\nsoft­hyphen")[1] == ["softhyphen"]


def test_uuencoded_text():
    import binascii

    line = binascii.b2a_uu(b"hidden words here").decode()
    assert "hidden words here" in read_message(f"Subject: a\n\nsee\n\nbegin 644 a.txt\n{line}`\nend\n")[1][0]
    assert "begin" not in read_message("Subject: a\n\nbegin 644 a.bin\n" + binascii.b2a_uu(bytes(range(30))).decode() + "`\nend\n")[1][0]
