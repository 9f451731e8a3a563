"""Inputs with artefacts and what the rules make of them, for queries whose logic SQL can't express.

Expected values are written down here from the rules, never computed by the code under test.
"""

from __future__ import annotations


def values(rows: list[tuple], columns: str) -> str:
    """Rows as a SQL table."""

    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


#: The whole pipeline: text, cleaned text.
CLEAN = [
    ("Emper- or", "Emperor"), ("self- evident", "self-evident"), ("ex- wife", "ex-wife"), ("all- knowing", "all-knowing"), ("well- known", "well-known"), ("ill- advised", "ill-advised"),
    ("W- What", "W- What"), ("d- don't", "d- don't"), ("re- read", "re- read"), ("snap-hiss", "snap-hiss"), ("twenty-five", "twenty-five"), ("Jean-Luc", "Jean-Luc"), ("twenty- one", "twenty-one"),
    ("full- scale", "full-scale"), ("apples, e.g. oranges", "apples, e.g. oranges"), ("id est, i.e. that is", "id est, i.e. that is"), ("See e.g. this.", "See e.g. this."),
    ("Some text ER ER ER more text", "Some text more text"), ("thththat", ""), ("Text\x07With\x1bControl", "TextWithControl"), ('end. " Start', "end. “Start"), ('end. "Start', "end. “Start"),
    ('end."Start', "end. “Start"), ('said Rowan." By', "said Rowan.” By"), ('" text "', "“text”"), ("' text '", "'text'"), ("What?''", "What?' '"),
    ("'You always taught us, sire-'' Speak, Edgar. '", "'You always taught us, sire-' 'Speak, Edgar.'"),
    ("'Speak, Edgar. ' 'You always taught us to speak the truth, even if our voices shake. 'Leander raised his head", "'Speak, Edgar.' 'You always taught us to speak the truth, even if our voices shake. 'Leander raised his head"),
    ("word , word", "word, word"), ("word .Word", "word. Word"), ("s o m e t e x t", "sometext"), ("This is fne stus.", "This is fine stuff."), ("The |mperium", "The Imperium"), ("Houſe of Cards", "House of Cards"),
    ("ﬁsh and ﬂips", "fish and flips"), ("ʃun", "fun"), ("Freſh fruit", "Fresh fruit"), ("Deɹne this", "Define this"), ("Oﬀice aﬀair", "Office affair"), ("Eﬃcient waﬄe", "Efficient waffle"),
    ("Cæsar & Phœnix", "Caesar & Phoenix"), ("ÆON FLUX & ŒDIPUS", "AEON FLUX & OEDIPUS"), ("It’ s working", "It's working"), ('He said,"Go"', "He said, “Go”"), ('"Stop"he said', "“Stop” he said"),
    ("Wait . . . now", "Wait now"), ("Start oceanofpdf.com End", "Start End"), ('smile."Or', "smile. “Or"), ("Marcus'eyes", "Marcus' eyes"), ("Courtney' s", "Courtney's"), ("Don' t do it", "Don't do it"), ("We' re here", "We're here"),
    ('S t a r s h i p : The |mperium\' s pow- er , said Marcus . " It is un- limited . "', "Starship: The Imperium's power, said Marcus. “It is unlimited.”"),
    ("Chapter 1\nStart", "\nStart"), ("CHAPTER XII\nStart", "\nStart"), ("Chapter One\nStart", "\nStart"), ("CONTENTS\nPART ONE\nStart", "Start"), ("A Fine Books Publication\nStory", ""),
    ('Dana said." He', "Dana said.” He"), ("demanded Alwin'. If", "demanded Alwin. 'If"), ("Alwin demanded'. If", "Alwin demanded. 'If"), ("", ""), (None, None),
]

#: Single steps: step, text, what the step alone makes of it.
STEPS = [
    ("whitespace", "a\tb   c\nd", "a b c\nd"), ("spaced_out", "a s p a c e d line", "aspaced line"), ("spaced_out", "x y and z", "x y and z"), ("spaced_out", "f o o" + "\n" + "b a r", "foo\nbar"),
    ("boilerplate", "story\nChapter IV\nmore", "story\nmore"), ("boilerplate", "story\nDedication\nfor you", "story"), ("boilerplate", "story\nContents\none\ntwo", "story"),
    ("boilerplate", "CONTENTS PART ONE PART TWO text", "text"), ("boilerplate", "plain words stay", "plain words stay"),
    ("ellipsis", "wait . . . . now. . .", "wait ... now..."), ("garbage", "bad ¦ line\ngood", "good"), ("garbage", "a ==== b ---- c", "a  b  c"), ("garbage", "x ab~cd y", "x  y"),
    ("garbage", "so aaaaaab here", "so  here"), ("garbage", "ababab stays not", " stays not"), ("garbage", "go go go on", " on"), ("garbage", "dots ...... end", "dots  end"), ("garbage", "one, two; three.", "one, two; three."),
    ("characters", "“q” ‘s’ – — | ſ…", "\"q\" 's' - - I s..."), ("collapse", "a   b  c", "a b c"),
    ("protect", "see https://a.b:80/c,d now", "see https<COLON>//a<PRD>b<COLON>80/c<COMMA>d now"), ("protect", "e.g. this� &amp; that", "e<PRD>g. this &amp<SEMICOLON> that"),
    ("restore", "a<PRD>b<COLON>c<COMMA>d<SEMICOLON>", "a.b:c,d;"), ("contractions", "that'sa trap", "that's a trap"), ("contractions", "James'hat", "James' hat"), ("contractions", "John 's hat", "John's hat"),
    ("contractions", "can' t", "can't"), ("contractions", "fne stus", "fine stuff"), ("quotes_before", '" hello', '"hello'), ("quotes_before", "hello ' , yes", "hello' , yes"), ("quotes_before", "so,'yes", "so, 'yes"),
    ("quotes_after", "word,'next", "word,' next"), ("quotes_after", "end.'Next", "end.' Next"), ("quotes_after", 'a . "he said', 'a . "he said'), ("quotes_after", "say!''go", "say!' 'go"), ("quotes_after", 'say-""go', 'say-" "go'),
    ("punctuation", "word'. Next", "word. 'Next"), ("punctuation", 'end."Next', 'end." Next'), ("punctuation", "so...Next", "so... Next"), ("punctuation", "ab ,cd", "ab, cd"), ("punctuation", "a ,b", "a,b"), ("punctuation", "one.two", "one. two"), ("punctuation", "J.K. Smith", "J.K. Smith"),
    ("heal_urls", "www. site. com", "www.site.com"), ("heal_urls", "http:// a.b/ c", "http://a.b/ c"), ("heal_urls", "no link. here", "no link. here"),
    ("smart_quotes", 'He said "go" now', "He said “go” now"), ("smart_quotes", 'end."He', "end. “He"), ("smart_quotes", '("x")', "(“x”)"), ("smart_quotes", 'say "one\n"two" x', "say “one\n“two” x"),
    ("heal_hyphens", "EMPER- OR", "EMPER- OR"), ("heal_hyphens", "emper- or", "emperor"), ("heal_hyphens", "Th- then", "Th- then"), ("heal_hyphens", "half- done", "half-done"),
]

#: Snippets: text, search term, snippet.
SNIPPETS = [
    ("The quick brown fox jumps over the lazy dog.", '"fox"', "The quick brown <b>fox</b> jumps over the lazy dog."),
    ("Mr. Fox is smart. He lives in a hole. See e.g. the diagram.", '"Fox"', "Mr. <b>Fox</b> is smart. He lives in a hole. See e.g. the diagram."),
    ("Written by J.K. Rowling in the 90s.", '"Rowling"', "Written by J.K. <b>Rowling</b> in the 90s."),
    ("Then he said, “I will catch that fox eventually, I promise.” The story ends.", '"fox"', "Then he said, “I will catch that <b>fox</b> eventually, I promise.” The story ends."),
    ("Use the <script> tag for the fox.", '"fox"', "Use the &lt;script&gt; tag for the <b>fox</b>."),
    ("She speaks for Kelda Hal, the General.", "kelda-hal", "She speaks for <b>Kelda Hal</b>, the General."), ("She speaks for Kelda-Hal, the General.", "kelda-hal", "She speaks for <b>Kelda-Hal</b>, the General."),
    ("The agent of KeldaHal came at dawn.", "kelda-hal", "The agent of <b>KeldaHal</b> came at dawn."), ("Foxes and a foxhole.", "fox*", "<b>Foxes</b> and a <b>foxhole</b>."), ("", "fox", ""),
    ("It begins. " + "Filler words stand here now. " * 40 + "The fox ran. " + "More filler follows on. " * 40, "fox", "Filler words stand here now. " * 11 + "The <b>fox</b> ran. " + "More filler follows on. " * 10 + "More filler follows on."),
]

#: Pages of one file and what is left without headers, footers and page numbers: page, text, text left.
HEADERS = [(n, f"The Long Book\nline {'abcdefghij'[n - 1]} of the story\nThe Long Book stands here\nPart {n} of 10\nmiddle {'klmnopqrst'[n - 1]}\nend {'abcdefghij'[n - 1]}\nlast {'klmnopqrst'[n - 1]}\n{n}",
            f"line {'abcdefghij'[n - 1]} of the story\nPart {n} of 10\nmiddle {'klmnopqrst'[n - 1]}\nend {'abcdefghij'[n - 1]}\nlast {'klmnopqrst'[n - 1]}") for n in range(1, 11)]

#: Files of one page each: text, status, number of junk pages, repeated characters, repeated tokens.
_PLAIN = "The people went there before they would come with their things from that place, and this is about what could have been after all of it. "
OCR = [
    (("S] " * 10 + "ER " * 10 + "\n") * 10, "redo"), ("M WS BS S T W A Ld Sv\n" + ("4 " * 8 + "5+\n") * 5, None), (_PLAIN * 6, None), ("", "redo"), ("ab", "missing"), ("a page of few words", None),
    ("zxqv bnmk " * 60, "redo"), ("Hellooooooo there " * 3, "redo"), ("¦ junk ¦", "redo"), ("12345 67890 " * 60, "redo"),
]

#: Titles: work, best local title, similarity (twice the letters in common, by the lengths of both).
LOCAL_TITLES = ["The Harbour Light.pdf", "Silver_Rivers.epub", "Night Over Mountains.pdf", "unrelated words.txt"]
TITLES = [("The Harbor Light", "The Harbour Light.pdf", 2 * 16 / 33), ("Silver Riverss", "Silver_Rivers.epub", 2 * 13 / 27), ("Mountain Nights", "Night Over Mountains.pdf", None), ("Quite Another Book", None, None)]

#: Pages that follow one another: first, second, both as one text, where the second begins.
_SHARED = "this passage stands at the end and at the beginning too"
MERGES = [
    ("one two", "three four", "one two three four", 8), (f"begin {_SHARED}", f"{_SHARED} and goes on", f"begin {_SHARED} and goes on", 6), ("emper-", "or came", "emperor came", 5), ("", "b", "b", 0), ("a", "", "a", 0),
]

#: Links: path, link.
LINKS = [("folder/doc.pdf", "/file/folder/doc.pdf#page=7"), ("a b/c+d.pdf", "/file/a%20b/c+d.pdf#page=7"), ("x\\y~z.pdf", "/file/x/y~z.pdf#page=7"), ("é?#%.pdf", "/file/%C3%A9%3F%23%25.pdf#page=7"), ("q&a (1), 'n'; $=@!.pdf", "/file/q&a%20(1),%20'n';%20$=@!.pdf#page=7")]
#: Paths and whether they are below /data/files.
CONTAINED = [("/data/files", True), ("/data/files/a/b", True), ("/data/files2", False), ("/data/files/../x", False), ("/data/x/../files/y", True), ("/data/./files//y/", True), ("/etc", False), ("/data/files/a/../../..", False), ("data/files", False)]
