"""Word lists and tables that the rules need. Membership decides results."""

from __future__ import annotations

# Suffixes under which the third label names the organisation.
MULTI_SUFFIXES = tuple(
    """
    co.uk org.uk ac.uk gov.uk me.uk net.uk sch.uk ltd.uk
    com.au net.au org.au edu.au gov.au id.au asn.au
    co.nz net.nz org.nz govt.nz ac.nz school.nz
    com.pk net.pk org.pk edu.pk gov.pk
    co.in net.in org.in ac.in edu.in gov.in firm.in gen.in
    com.bd net.bd org.bd edu.bd gov.bd
    com.br net.br org.br gov.br edu.br
    com.cn net.cn org.cn gov.cn edu.cn ac.cn
    co.jp ne.jp or.jp ac.jp go.jp lg.jp
    co.kr or.kr go.kr ne.kr re.kr
    com.sg com.my com.hk com.tw com.tr com.mx com.ar com.co com.pe com.ve com.uy com.ec
    co.za org.za net.za gov.za ac.za
    com.sa com.eg com.ng com.gh com.ke com.tz com.ma com.ua com.ru org.ru net.ru edu.ru gov.ru
    co.il org.il net.il ac.il gov.il
    com.es com.pl com.pt com.gr com.ro com.vn com.ph
    co.id or.id web.id ac.id go.id co.th in.th ac.th go.th
    com.ae net.ae org.ae gov.ae ac.ae com.qa com.kw com.bh com.om com.jo com.lb com.iq
    co.ke co.ug co.tz co.zm
    eu.com us.com uk.com gb.com cn.com de.com br.com
    github.io gitlab.io blogspot.com herokuapp.com web.app azurewebsites.net firebaseapp.com pages.dev workers.dev
    vercel.app netlify.app glitch.me repl.co ngrok.io ngrok-free.app onrender.com surge.sh weeblysite.com
    sharepoint.com myshopify.com wixsite.com square.site
    """.split()
)

# Mailbox and throwaway providers, whose domain says nothing about a person.
FREEMAIL = tuple(
    """
    gmail.com googlemail.com yahoo.com yahoo.co.uk yahoo.co.in yahoo.fr yahoo.de yahoo.com.br yahoo.ca yahoo.com.au
    ymail.com rocketmail.com outlook.com outlook.co.uk hotmail.com hotmail.co.uk hotmail.fr hotmail.it live.com
    live.co.uk msn.com aol.com icloud.com me.com mac.com protonmail.com proton.me pm.me tutanota.com tuta.io
    gmx.com gmx.de gmx.net web.de mail.com email.com yandex.com yandex.ru zoho.com fastmail.com hushmail.com hey.com
    mail.ru inbox.ru list.ru bk.ru rambler.ru qq.com 163.com 126.com sina.com foxmail.com naver.com daum.net
    hanmail.net rediffmail.com sify.com t-online.de orange.fr free.fr laposte.net wanadoo.fr sfr.fr libero.it
    virgilio.it alice.it tiscali.it uol.com.br bol.com.br terra.com.br comcast.net verizon.net att.net sbcglobal.net
    cox.net bellsouth.net charter.net btinternet.com sky.com talktalk.net virginmedia.com shaw.ca rogers.com
    mailinator.com guerrillamail.com 10minutemail.com yopmail.com temp-mail.org sharklasers.com throwawaymail.com
    """.split()
)

# Words bolted onto a real name to make a cousin domain.
COUSIN_AFFIXES = tuple(
    """
    secure security login signin account accounts verify verification update support help service services mail email
    webmail portal billing invoice invoices payment payments payroll hr finance admin auth sso id online web app my
    team corp inc ltd group official alert alerts notice notify care center centre desk net info global intl new confirm
    """.split()
)

# Glyphs that look alike, replaced in this order.
CONFUSABLES = (
    ("rn", "m"), ("vv", "w"), ("cl", "d"), ("nn", "m"), ("0", "o"), ("1", "l"), ("l", "i"), ("5", "s"),
    ("3", "e"), ("7", "t"), ("8", "b"), ("9", "g"), ("2", "z"), ("4", "a"), ("6", "g"),
)

# Fixed values.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "ARMENIAN", "CHEROKEE", "DEVANAGARI", "HAN", "HANGUL")
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir", "eng", "engr", "capt")

# Domains that sign for others by design.
DELEGATED_SIGNERS = tuple(
    """
    gappssmtp.com amazonses.com sendgrid.net mailgun.org mcsv.net mcdlv.net rsgsv.net sparkpostmail.com
    mandrillapp.com postmarkapp.com sendinblue.com brevo.com zoho.com hubspot.com salesforce.com intercom.io
    customeriomail.com klaviyomail.com mailchimp.com constantcontact.com icloud.com outlook.com
    """.split()
)

# Parts of an address that name a machine.
AUTOMATED = tuple(
    """
    no-reply noreply no_reply donotreply do-not-reply do_not_reply automated automatic notification notifications
    alert alerts mailer mail-daemon bounce bounces postmaster news newsletter updates digest receipts billing invoice
    service system info hello team support help care express account
    """.split()
)

# Link shorteners, free hosts, click trackers.
SHORTENERS = tuple(
    """
    bit.ly tinyurl.com t.co goo.gl ow.ly buff.ly is.gd cutt.ly rb.gy shorturl.at tiny.cc rebrand.ly bl.ink lnkd.in
    trib.al s.id v.gd t.ly shorte.st adf.ly short.io soo.gd clck.ru qps.ru u.to chilp.it lc.cx
    """.split()
)
FREE_HOSTING = tuple(
    """
    pages.dev workers.dev vercel.app netlify.app web.app firebaseapp.com github.io gitlab.io glitch.me repl.co
    replit.dev ngrok.io ngrok-free.app onrender.com surge.sh r2.dev blob.core.windows.net s3.amazonaws.com
    storage.googleapis.com wixsite.com weeblysite.com square.site sites.google.com forms.gle formspree.io
    typeform.com notion.site webflow.io framer.website duckdns.org 000webhostapp.com
    """.split()
)
TRACKERS = tuple(
    """
    awstrack.me sendgrid.net ct.sendgrid.net sparkpostmail.com mailgun.org mandrillapp.com list-manage.com mcsv.net
    mcdlv.net rsgsv.net createsend.com cmail19.com cmail20.com exct.net rs6.net hubspotlinks.com hs-sites.com
    pardot.com mktdns.com sendibt2.com sendibm1.com sendibm3.com klclick.com klclick1.com postmarkapp.com
    customeriomail.com intercom-mail.com braze.com sparkpost.com mixmax.com yesware.com bnc.lt sng.link app.link
    adj.st onelink.me go-mail.io mailanyone.net email.mg links.notifications e.customeriomail.com mail.crayo.ai
    """.split()
)

# Words of a page that asks for credentials, parameters that carry a URL, schemes that run code.
CREDENTIAL_WORDS = tuple(
    """
    login logon signin sign-in auth authenticate verify verification validate account accounts secure security update
    confirm confirmation password passwd credential reset unlock recover recovery webmail owa office365 o365 mfa 2fa
    otp token session billing invoice payment wallet seed mnemonic kyc
    """.split()
)
REDIRECT_PARAMS = tuple(
    "url redirect redirect_uri redirect_url next continue returnurl return_url return_to dest destination goto target r u link out forward to".split()
)
DANGEROUS_SCHEMES = ("javascript", "data", "vbscript", "file")

# File extensions by what they do.
EXTENSIONS = {
    "executable": "exe scr com pif msi msp cpl jar app dmg pkg deb rpm run bin gadget msix appx".split(),
    "script": "js jse vbs vbe wsf wsh ps1 psm1 psc1 bat cmd sh hta reg scf inf url application msc settingcontent-ms library-ms chm vb vbscript ws".split(),
    "container": "iso img vhd vhdx cab ace arj lnk xz".split(),
    "macro_office": "docm xlsm pptm dotm xltm potm xlsb xlam ppam".split(),
    "web": "html htm shtml xhtml mhtml mht svg".split(),
    "archive": "zip rar 7z tar gz bz2 tgz zipx".split(),
    "legacy_office": "doc xls ppt dot xlt pot rtf".split(),
    "onenote": "one onepkg".split(),
}
DOCUMENT_LOOKING = "pdf doc docx xls xlsx ppt pptx txt csv rtf jpg jpeg png gif zip odt ods eml msg xml json".split()
EXPECTED_TYPES = {
    "pdf": ["application/pdf"],
    "zip": ["application/zip", "application/x-zip-compressed", "application/octet-stream"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    "xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
    "png": ["image/png"], "jpg": ["image/jpeg"], "jpeg": ["image/jpeg"], "gif": ["image/gif"],
    "html": ["text/html"], "htm": ["text/html"], "txt": ["text/plain"],
}
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u200e\u200f"
PASSWORD_HINT = r"\b(?:pass(?:word|wd|code)?|pwd|p/w|unlock\s+code|decryption\s+key)\b\s*(?:is|:|=)?"

# The function words and scalar features of a style vector, in its order.
FUNCTION_WORDS = tuple(
    """
    the of and to a in that is was it for as with his on be at by i this had not are but from or have an they which
    you were her all she there would their we him been has when who will more if no out so said what up its about
    into than them can only
    """.split()
)
STYLE_SCALARS = tuple(
    """
    avg_sentence_len sentence_len_sd avg_word_len type_token_ratio comma_rate period_rate exclaim_rate question_rate
    semicolon_rate dash_rate ellipsis_rate apostrophe_rate uppercase_word_rate lowercase_start_rate contraction_rate
    emoji_rate digit_rate paragraph_rate line_len_mean double_space_rate
    """.split()
)
GREETING = r"^\s*(hi|hello|hey|dear|good\s+(?:morning|afternoon|evening)|greetings|salaam|assalam|aoa|yo|hiya|morning|afternoon)\b[^\n]{0,40}"
SIGNOFF = r"^\s*(thanks|thank you|regards|best regards|best|kind regards|cheers|sincerely|yours|br|rgds|take care|talk soon|many thanks|warm regards)\b"
QUOTED = r"^\s*(>|On .{5,60} wrote:|-{2,}\s*Original Message)"

# Headers that relays add, by prefix; statuses of authentication.
RELAY_HEADERS = tuple(
    """
    received arc- x-google x-gm- x-received dkim-signature authentication-results x-originating-ip return-path
    delivered-to x-spam x-virus x-ms-exchange x-forefront x-microsoft-antispam
    """.split()
)
FAIL, SOFT = ("fail", "permerror"), ("softfail", "neutral", "none", "temperror")

# HTML elements without content, elements without prose, styles that hide.
VOID_TAGS = frozenset("meta link base br hr img input source track wbr area col embed param".split())
SILENT_TAGS = frozenset("script style head title meta link".split())
HIDING = ("display:none", "visibility:hidden", "opacity:0", "mso-hide:all")

# Severity and base weight of each intent.
INTENTS = {
    "payment_redirection": ("critical", 0.88), "credential_request": ("critical", 0.85), "malware_delivery": ("high", 0.80),
    "authority_impersonation": ("high", 0.74), "data_request": ("high", 0.66), "advance_fee": ("high", 0.72),
    "extortion": ("high", 0.78), "off_channel_push": ("medium", 0.58), "other_suspicious": ("medium", 0.48),
}
SEVERITIES = ("info", "low", "medium", "high", "critical")
#: How far mitigation may relieve a layer whose worst finding has this severity.
RELIEF = {"critical": 0.05, "high": 0.25, "medium": 0.55, "low": 0.80, "info": 0.90}
